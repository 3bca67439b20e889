"""Paths that need packages which may be absent, run with stand-ins for them."""

import contextlib
import sys
import types

import numpy as np
import pytest

from lodestone.operators.embed import ModelEmbedder, embed_texts, warm_up
from lodestone.operators.fusion import CrossEncoderReranker
from lodestone.sources.parsers import parse


def package(monkeypatch, name, **content):
    made = types.ModuleType(name)
    for key, value in content.items():
        setattr(made, key, value)
    monkeypatch.setitem(sys.modules, name, made)
    return made


@pytest.fixture
def models(monkeypatch):
    tried = []

    class Model:
        def __init__(self, name, local_files_only=False):
            tried.append((type(self).__name__, name, local_files_only))
            if local_files_only and name != "local" or name == "missing":
                raise OSError("not here")

    class SentenceTransformer(Model):
        def encode(self, texts, normalize_embeddings, convert_to_numpy, show_progress_bar):
            assert normalize_embeddings and convert_to_numpy and not show_progress_bar
            return np.array([[len(t), 1.0] for t in texts]) / np.array([[np.hypot(len(t), 1)] for t in texts])

    class CrossEncoder(Model):
        def predict(self, pairs):
            return np.array([1.0 if q == t else 0.25 for q, t in pairs])

    package(monkeypatch, "sentence_transformers", SentenceTransformer=SentenceTransformer, CrossEncoder=CrossEncoder)
    monkeypatch.setattr(ModelEmbedder, "_loaded", {})
    monkeypatch.setattr(CrossEncoderReranker, "_loaded", {})
    return tried


def test_embedder_loads_once(models):
    e = ModelEmbedder("remote", 2)
    assert embed_texts(e, ["abc", "d"]).shape == (2, 2) and e.encode(["x"]).shape == (1, 2)
    assert models == [("SentenceTransformer", "remote", True), ("SentenceTransformer", "remote", False)]
    asked = embed_texts(e, ["abc"], is_query=True)
    assert asked[0, 0] > embed_texts(e, ["abc"])[0, 0] and e.prefix  # the prefix makes a question longer
    warm_up(ModelEmbedder("local", 2), None)
    assert models[-1] == ("SentenceTransformer", "local", True) and len(models) == 3
    for _ in range(2):  # a failure is not remembered
        with pytest.raises(RuntimeError, match="missing"):
            ModelEmbedder("missing", 2).encode(["x"])
    assert len(models) == 7


def test_reranker_loads_once(models):
    r = CrossEncoderReranker("remote")
    assert r.score(["a", "b"], ["a", "c"]) == [1.0, 0.25] and r.score([], []) == []
    assert len(models) == 2
    with pytest.raises(RuntimeError, match="missing"):
        CrossEncoderReranker("missing").score(["a"], ["a"])


class Reader:
    def extract_image_bytes(self, content, mime_type):
        return f"{mime_type} {content.decode()}" if content != b"2" else ""


@pytest.fixture
def pdf(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "broken":
                raise ValueError
            return self.text

    class PdfReader:
        def __init__(self, stream):
            text = stream.read().decode()
            self.pages = [Page(t or None) for t in text.split("|")]

    class Pixmap:
        def __init__(self, n):
            self.n = n

        def tobytes(self, kind):
            assert kind == "png"
            return str(self.n).encode()

    class Document(list):
        def load_page(self, i):
            return types.SimpleNamespace(get_pixmap=lambda matrix, alpha: Pixmap(i + 1 if matrix == ("zoom", 2.0) and not alpha else 0))

    @contextlib.contextmanager
    def opened(stream, filetype):
        assert filetype == "pdf"
        yield Document(stream.decode().split("|"))

    package(monkeypatch, "pypdf", PdfReader=PdfReader)
    package(monkeypatch, "fitz", open=opened, Matrix=lambda x, y: ("zoom", x) if x == y else None)


def test_pdf_text(pdf):
    assert parse("a.pdf", b"one|broken||four words stand on this page") == "one\n\n\nfour words stand on this page"


def test_pdf_with_hardly_any_text_is_read_by_ocr(pdf):
    assert parse("a.pdf", b"x| |y", Reader(), ocr_pages=3, ocr_dpi=144) == "[第 1 页]\nimage/png 1\n\n[第 3 页]\nimage/png 3"
    assert parse("a.pdf", b"x| |y", Reader(), ocr_pages=1, ocr_dpi=144) == "[第 1 页]\nimage/png 1"
    assert parse("a.pdf", b"x| |y") == "x\n \ny"
    lines = b"|".join([b"short"] * 5)  # five lines of five characters: their ends count, too
    assert parse("a.pdf", lines, Reader(), ocr_least=29) == "\n".join(["short"] * 5)
    assert "image/png" in parse("a.pdf", lines, Reader(), ocr_least=30)
    assert "image/png" in parse("a.pdf", b"a" + b" " * 80 + b"b", Reader(), ocr_least=30)
    assert parse("a.pdf", b"long enough text for a page, so no OCR", Reader()) == "long enough text for a page, so no OCR"


def test_without_the_packages(monkeypatch):
    for name in ("pypdf", "fitz"):
        monkeypatch.setitem(sys.modules, name, None)
    with pytest.raises(ValueError, match="pypdf"):
        parse("a.pdf", b"x")
