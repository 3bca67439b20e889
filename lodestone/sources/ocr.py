"""OCR is a provider that is handed in; none is bundled."""

from __future__ import annotations

import base64
from collections.abc import Callable
from typing import Protocol


class OCRProvider(Protocol):
    def extract_image_bytes(self, content: bytes, mime_type: str) -> str: ...


class VisionChatOCR:
    """A chat model that reads images: the image goes as a data URL, the answer is stripped; failures are tried again."""

    PROMPT = "请提取图片中的全部文字，保持原有顺序，只输出文字。"

    def __init__(self, chat: Callable[[list[dict]], str], retries: int = 2):
        self.chat, self.retries = chat, retries

    def extract_image_bytes(self, content: bytes, mime_type: str) -> str:
        url = f"data:{mime_type};base64,{base64.b64encode(content).decode()}"
        message = {"role": "user", "content": [{"type": "image_url", "image_url": {"url": url}}, {"type": "text", "text": self.PROMPT}]}
        for left in range(self.retries, -1, -1):
            try:
                return (self.chat([message]) or "").strip()
            except Exception:
                if not left:
                    raise
        raise AssertionError


#: Names under which the vision chat provider is known.
PROVIDERS = dict.fromkeys(("qwen-vl", "qwen", "openai-compatible"), VisionChatOCR)


def ocr_provider(name: str, chat: Callable[[list[dict]], str]) -> OCRProvider:
    key = (name or "").strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"unknown OCR provider {name}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[key](chat)
