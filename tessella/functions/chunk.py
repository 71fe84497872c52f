"""Recursive character splitter as an Arrow UDF: chunks of bounded size with bounded overlap."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Separators, from the strongest to none.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text; a separator stays at the head of the piece after it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + x for x in rest)) if p]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``; the tail of each chunk, up to ``overlap``, starts the next."""
    out: list[str] = []
    held: deque[str] = deque()
    total = 0
    for piece in pieces:
        n = len(piece)
        if total + n > size and held:
            out.append("".join(held).strip())
            while total > overlap or (total and total + n > size):
                total -= len(held.popleft())
        held.append(piece)
        total += n
    out.append("".join(held).strip())
    return [x for x in out if x]


def split(text: str, size: int = 500, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += _joined(short, size, overlap)
            short = []
        out += split(piece, size, overlap, rest) if rest else [piece]
    return out + (_joined(short, size, overlap) if short else [])


def chunks(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Array of chunks; null and blank texts give none."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([split(x, size, overlap) if x and x.strip() else [] for x in column], dtype=object)

    return run(text)


class RecursiveChunks:
    """The table function recursive_chunks(text, size, overlap): rows (pos, chunk), sizes 500 and 80 by default."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument is a text")
        for name, given, least in (("size", size, 1), ("overlap", overlap, 0)):
            if given is not None and (not given.isConstantExpression or given.value is None or given.value < least):
                raise ValueError(f"{name} is a constant of {least} or more")
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("chunk", StringType()))

    def eval(self, text, size=500, overlap=80):
        if text and text.strip():
            yield from enumerate(split(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Makes the table functions of the package known to the session's SQL, for use with LATERAL."""
    spark.udtf.register("recursive_chunks", F.udtf(RecursiveChunks))
