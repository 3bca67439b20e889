"""Splitting texts into chunks: windows of approximate tokens (native), or recursively by separators (an Arrow UDF)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import chunk_strategy
from lodestone.functions.text import HAN, SPACE, clean_text, content_hash, strip

#: Separators from the strongest to single characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", " ", "")
#: No two kinds begin alike, so the most frequent comes first.
UNITS = rf"(?U)(?-U:[A-Za-z0-9_]){{1,4}}|{SPACE}+|[{HAN}]|[^\s\x1c-\x1f]"


def token_units(c: Column) -> Column:
    """Runs of white space, Han characters, pieces of up to four ASCII word characters, and other single characters."""
    return F.regexp_extract_all(c, F.lit(UNITS), F.lit(0))


def split_tokens(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` units that share `overlap`, joined, stripped, blank ones dropped.

    Units follow one another without gaps, so a text is cut into blocks of as many units as divide both the windows and
    the steps between them, and a window is a few whole blocks.
    """
    if size <= 0:
        raise ValueError("chunk size must be above 0")
    step = size - max(0, min(overlap, size - 1))
    own = math.gcd(size, step)
    blocks = F.regexp_extract_all(c, F.lit(rf"(?:{UNITS}){{1,{own}}}+"), F.lit(0))

    def windows(found: Column) -> Column:
        n = (F.size(found) - 1) * own + F.size(token_units(F.element_at(found, -1)))
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.array_join(F.slice(found, i * (step // own) + 1, F.lit(size // own)), "")))
        return F.when(F.size(found) > 0, F.filter(cut, lambda x: x != "")).otherwise(F.array().cast("array<string>"))

    # bound to a variable: otherwise the blocks would be worked out anew for every window
    return F.transform(F.array(blocks), windows)[0]


def split_chars(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split by the first separator the text holds, pieces too long by the next ones; pieces are merged up to `size`
    characters, and a chunk begins with as many whole pieces of the one before as fit into `overlap`."""
    used = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark = separators[used]
    if mark == "":
        parts = list(text)
    else:
        head, *rest = text.split(mark)
        parts = [p for p in (head, *(mark + r for r in rest)) if p]
    chunks: list[str] = []
    short: list[str] = []
    for part in [*parts, None]:
        if part is not None and len(part) < size:
            short.append(part)
            continue
        chunks += _merge(short, size, overlap)
        short = []
        if part is not None:
            weaker = separators[used + 1 :]
            chunks += split_chars(part, size, overlap, weaker) if weaker else [part]
    return chunks


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    lo = total = 0
    for hi, part in enumerate(parts):
        if total + len(part) > size and hi > lo:
            chunks.append("".join(parts[lo:hi]).strip())
            while lo < hi and (total > overlap or total + len(part) > size):
                total -= len(parts[lo])
                lo += 1
        total += len(part)
    chunks.append("".join(parts[lo:]).strip())
    return [c for c in chunks if c]


def char_splitter(size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS):
    """split_chars as an Arrow-backed UDF text -> array<string>."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_chars(t, size, overlap, separators) if t else [])

    return run


def split_text(c: Column, size: int, overlap: int, strategy: str = "char") -> Column:
    if chunk_strategy(strategy) == "token":
        return split_tokens(c, size, overlap)
    return char_splitter(size, overlap)(c)


def chunk_documents(docs: DataFrame, size: int, overlap: int, strategy: str = "char", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (source, text and the columns in keep) to chunks: source, chunk_index, text, content_hash and keep.

    Indexes are given before blank pieces are dropped. A blank text gives no chunk.
    """
    cut = split_text(clean_text("text"), size, overlap, strategy)
    pieces = docs.select("source", *keep, F.posexplode(cut).alias("chunk_index", "text"))
    if chunk_strategy(strategy) != "token":  # windows of tokens are stripped, and none is blank
        pieces = pieces.withColumn("text", strip("text")).where("text <> ''")
    return pieces.select("source", *keep, "chunk_index", "text", content_hash("text").alias("content_hash"))
