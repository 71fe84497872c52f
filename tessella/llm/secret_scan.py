"""Secret scan with multipart credential linking.

Certain kinds (assignments, access keys, long hex) are reported wherever they stand. Weak parts
(account identifiers, bare secret-like strings, endpoints) are common in clean text and are only
reported when parts of complementary kinds stand within one scope: the parts of a document are
intervals, and an interval join over their sorted starts finds, for every weak part, whether an
identifier, a secret and an endpoint come within ``scope`` code points of each other.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ACCOUNT = re.compile(
    r"""\b(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.I | re.A,
)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
_ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>|]+"""
    r"""|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?""",
    re.I | re.A,
)

#: What each kind can be a part of a credential as. Identifiers, secrets and endpoints complement each other.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "bare": "secret", "endpoint": "place"}

Span = tuple[int, int, str]


def certain(text: str) -> list[Span]:
    """Spans (start, end, kind) of the kinds that need no context."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def weak(text: str) -> list[Span]:
    """Spans of the kinds that are reported only when linked."""
    found = [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text)]
    found += [
        (m.start(), m.end(), "bare")
        for m in _BARE.finditer(text)
        if re.search(r"[a-z]", m[0]) and re.search(r"[A-Z]", m[0]) and re.search(r"[0-9]", m[0])
    ]
    return found + [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]


def linked(parts: list[Span], scope: int) -> list[Span]:
    """The weak spans with a complementary part within ``scope``: an identifier needs a secret, a bare
    secret an identifier, an endpoint both.

    Starts and running maxima of ends are sorted by role, so each test is two binary searches and no
    pairs are made. A part does not link with one that it overlaps.
    """
    starts = {r: sorted(s for s, _, k in parts if ROLE[k] == r) for r in ("id", "secret", "place")}
    ends = {r: sorted(e for _, e, k in parts if ROLE[k] == r) for r in ("id", "secret", "place")}

    def near(role: str, start: int, end: int) -> bool:
        i = bisect_left(starts[role], end)
        if i < len(starts[role]) and starts[role][i] <= end + scope:
            return True
        j = bisect_left(ends[role], start + 1)
        return j > 0 and ends[role][j - 1] >= start - scope

    needs = {"account": ("secret",), "bare": ("id",), "endpoint": ("id", "secret")}
    return [p for p in parts if p[2] in needs and all(near(r, p[0], p[1]) for r in needs[p[2]])]


def spans_of(text: str, scope: int) -> tuple[list[Span], list[Span]]:
    """Certain spans, and all spans that are reported, by start and kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(certain(text), key=order)
    covered = {(s, e) for s, e, _ in base}
    parts = [p for p in weak(text) if (p[0], p[1]) not in covered]
    return base, sorted(base + linked(base + parts, scope), key=order) if parts else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(scope: int):
    def run(batches):
        for batch in C.slices(batches):
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text or "", scope)
                kinds = [x[2] for x in base]
                for column, k in zip(columns[:3], KINDS[:3], strict=True):
                    column.append(kinds.count(k))
                columns[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[4].append(joined(every))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Finds secrets in ``docs`` (doc_id, text), whole texts.

    Returns a row per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the certain
    spans) and spans (certain and linked weak ones), both as kind:start:end joined by commas, in
    code points, by start and then kind. A null text counts as empty; repeated rows get equal
    results; further columns are ignored; an empty table gives no rows.
    """
    return docs.select(*C.id_and_text(docs)).mapInArrow(
        _scan(scope),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact(text: str | None, scope: int = 300) -> str | None:
    """The text with every reported span replaced by [kind]; overlapping spans are merged under the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans_of(text, scope)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``docs`` with secrets in text replaced; n_chars, where it exists, follows the new text.

    Null and empty texts stay as they are, the n_chars of a null text is null. Repeated rows get equal
    texts; further columns are unchanged; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = pd.Series([redact(x, scope) for x in text], dtype=object)
        C.give_back()
        return out

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
