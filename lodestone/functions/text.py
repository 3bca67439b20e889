"""Column functions on text. All are JVM expressions that stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space: for Java's regular expressions, to which a named class is faster than a list, and as characters.
SPACE = r"[\s\x1c-\x1f]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HAN = r"\x{4e00}-\x{9fff}"
#: Put before a question, not before a passage, when it is embedded.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："
UNKNOWN_SOURCE = "未知"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end, as Unicode defines it."""
    return F.btrim(_col(c), F.lit(BLANKS))


def clean_text(c: Column | str) -> Column:
    """Control characters dropped, runs of blanks and tabs one blank, three or more newlines two; stripped; null is empty."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), CONTROL, "")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))  # a blank alone stays


def cleaned(text: str | None) -> str:
    """clean_text() of one Python string."""
    kept = re.sub(r"[ \t]+", " ", re.sub(CONTROL, "", text or ""))
    return re.sub(r"\n{3,}", "\n\n", kept).strip()


def content_hash(c: Column | str) -> Column:
    """MD5 of the text without any white space: the identity of a chunk."""
    return F.md5(F.regexp_replace(_col(c), rf"(?U){SPACE}+", ""))


def estimate_tokens(c: Column | str) -> Column:
    """Han characters, plus a quarter of the others, plus one; 0 for an empty or null text."""
    text = _col(c)
    han = F.length(F.regexp_replace(text, f"[^{HAN}]+", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise((han + F.floor((F.length(text) - han) / 4) + 1).cast("int"))


def extract_json(c: Column | str) -> Column:
    """From the first `{` to the last `}`, if that parses; else null."""
    found = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    alone = F.concat(F.lit("["), found, F.lit("]"))  # the parser stops after one value; in an array all of it must fit
    return F.when(F.try_parse_json(alone).isNotNull() & (found != ""), found)


def escape_html(c: Column | str) -> Column:
    out = _col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def preview(c: Column | str, size: int = 80) -> Column:
    return F.substring(F.replace(_col(c), F.lit("\n"), F.lit(" ")), 1, size)


def extension(path: Column | str) -> Column:
    """Lower-case extension of the base name with its dot, or empty; a name's leading dots begin none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.][^/]*?(\.[^./]*)$", 1))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def query_text(c: Column | str) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), _col(c))
