"""File formats, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.config import Settings

#: The extensions of each family.
SUPPORTED = {
    "text": (".txt", ".md", ".csv", ".json", ".jsonl", ".xml", ".html", ".htm"),
    "pdf": (".pdf",),
    "office": (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".rtf", ".odt", ".ods", ".odp"),
    "ebook": (".epub",),
    "image_ocr": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif"),
}
#: Formats that only the vendor's own program reads.
LEGACY = frozenset({".doc", ".xls", ".ppt"})


def extensions() -> list[str]:
    return sorted(e for family in SUPPORTED.values() for e in family)


def family_of(ext: str) -> str:
    for family, own in SUPPORTED.items():
        if ext in own:
            return family
    raise ValueError(f"unsupported file type {ext or '(none)'}; supported: {', '.join(extensions())}")


def supported_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, e) for f, own in SUPPORTED.items() for e in own], "family string, extension string")


#: What a user should know of a family, by the part of describe() it is shown under.
ADVICE = {
    "pdf": "The text layer is read. Pages that have next to none become images for OCR, where that is switched on.",
    "legacy_office": f"{', '.join(sorted(LEGACY))}: open and save them in the newer format first.",
    "ocr": "Pictures, and PDFs of pictures, need an OCR provider and enable_ocr.",
    "chunking": "token cuts windows of estimated tokens; any other name splits at ever weaker separators.",
}
#: Names in describe() of the settings shown there, by part.
SHOWN = {
    "ocr": {"enabled": "enable_ocr", "provider": "ocr_provider", "model": "ocr_model", "max_pdf_pages": "ocr_max_pages", "dpi": "ocr_dpi"},
    "chunking": {"strategy": "normalized_chunk_strategy", "chunk_size": "chunk_size", "chunk_overlap": "chunk_overlap"},
    "vector_store": {"embedding_model": "embedding_model"},
}


def describe(settings: Settings) -> dict:
    """Formats, OCR settings, chunking and store, generated from the registry and the settings."""
    out: dict = {part: {label: getattr(settings, name) for label, name in names.items()} for part, names in SHOWN.items()}
    out["vector_store"]["provider"] = "parquet"
    return out | {"supported": {family: [*own] for family, own in SUPPORTED.items()}, "unsupported": {}, "notes": dict(ADVICE)}
