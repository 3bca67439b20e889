"""Masking of personal data: ordered rules, each applied to what the ones before left."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PiiRule:
    name: str
    pattern: str
    mask: str


#: Patterns and masks, in order. Digits are those of any script.
RULES = (
    PiiRule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    PiiRule("phone", r"(?<!\p{Nd})1[3-9]\p{Nd}{9}(?!\p{Nd})", "[PHONE]"),
    PiiRule("id_card", r"(?<!\p{Nd})\p{Nd}{17}[\p{Nd}Xx](?!\p{Nd})", "[ID_CARD]"),
    PiiRule("bank_card", r"(?<!\p{Nd})\p{Nd}{16,19}(?!\p{Nd})", "[BANK_CARD]"),
)


def mask(c: Column, enabled: bool = True, rules: tuple[PiiRule, ...] = RULES) -> Column:
    """The masked text; unchanged if disabled. Null stays null."""
    for rule in rules if enabled else ():
        c = F.regexp_replace(c, rule.pattern, rule.mask)
    return c


def hits(c: Column, enabled: bool = True, rules: tuple[PiiRule, ...] = RULES) -> Column:
    """Number of masks put in; 0 for null."""
    total = F.lit(0)
    for rule in rules if enabled else ():
        total = total + F.coalesce(F.regexp_count(c, F.lit(rule.pattern)), F.lit(0))
        c = F.regexp_replace(c, rule.pattern, rule.mask)
    return total.cast("int")


def mask_history(history: Column, enabled: bool = True) -> Column:
    """Mask `content` in an array of structs; other fields stay."""
    return F.transform(history, lambda x: x.withField("content", mask(x["content"], enabled)))


_PYTHON_RULES = [(re.compile(r.pattern.replace(r"\p{Nd}", r"\d")), r.mask) for r in RULES]


def mask_text(text: str) -> tuple[str, int]:
    """The masked text and the number of masks: the driver's form of mask() and hits(), for one request."""
    total = 0
    for pattern, mask in _PYTHON_RULES:
        text, n = pattern.subn(mask, text)
        total += n
    return text, total
