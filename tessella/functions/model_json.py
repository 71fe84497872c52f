"""JSON in model answers: tolerant parsing, field aliases, envelopes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _fenced(text: str) -> str:
    for fence in ("```json", "```"):
        if fence in text:
            return text.split(fence, 1)[1].split("```", 1)[0]
    return text


def _candidates(text: str):
    """Readings of an answer, the most literal first."""
    yield text.strip()
    for opening, closing in ("[]", "{}"):
        start, end = text.find(opening), text.rfind(closing)
        if 0 <= start < end:
            yield text[start : end + 1]
    closed = text.strip()
    for opening, closing in ("[]", "{}"):
        if closed.startswith(opening):
            closed += "" if closed.endswith(closing) else closing
            break
    yield re.sub(r",\s*([}\]])", r"\1", closed)


def parse(text: str | None):
    """The first reading that is JSON, else None."""
    for candidate in _candidates(_fenced((text or "").strip())):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def field(item: dict, names: list[str]) -> str:
    """The first alias with a truthy, non-blank value; exact names first, then whatever their case."""
    folded = {k.lower(): v for k, v in item.items()}
    for source, key in ((item, str), (folded, str.lower)):
        for name in names:
            value = source.get(key(name))
            if value and str(value).strip():
                return str(value).strip()
    return ""


def items_of(answer) -> list[dict]:
    """Records of an answer: a list, or what its 'requirements' or 'raw' holds; anything else gives none."""
    if isinstance(answer, dict):
        answer = answer.get("requirements", answer.get("raw", []))
    return [x for x in answer if isinstance(x, dict)] if isinstance(answer, list) else []


def canonical(text: Column) -> Column:
    """Canonical JSON text of an answer, null where nothing can be read."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        out = [parse(x) for x in column]
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in out], dtype=object)

    return run(text)


def alias(fields: Column, names: list[str]) -> Column:
    """``field`` over a map of strings, as an expression."""
    folded = F.transform_keys(fields, lambda k, v: F.lower(k))
    usable = lambda v: F.nullif(strip(v), F.lit(""))
    exact = [usable(F.try_element_at(fields, F.lit(n))) for n in names]
    loose = [usable(F.try_element_at(folded, F.lit(n.lower()))) for n in names]
    return F.coalesce(*exact, *loose, F.lit(""))


def confidence(value: Column) -> Column:
    """A number, 0.5 where there is none or it can't be read."""
    return F.coalesce(value.try_cast("double"), F.lit(0.5))
