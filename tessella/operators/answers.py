"""Records in model answers: by VARIANT where an answer is plain JSON, by Python for the rest, and what can't be read is kept.

Most answers are JSON and nothing else; those never leave the JVM. An answer with talk around it, a fence,
a trailing comma or anything that Python would print in its own way goes to the tolerant reader. Both give
the same rows. An answer that neither can read goes to a quarantine table with its text and the reason.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model_json as J

_SIMPLE = "('STRING', 'BIGINT', 'VOID')"


def literal(text: Column) -> Column:
    """The value of a text that is JSON from end to end, else null: a reader that stops early would pass over what follows.

    In brackets a text with anything after its value is no array of one value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.size(wrapped.cast("array<variant>")) == 1, F.try_variant_get(wrapped, "$[0]", "variant"))


def _sql(expression: str, names: list[str]) -> Column:
    listed = "array(" + ", ".join("'" + n.lower().replace("'", "''") + "'" for n in names) + ")"
    return F.expr(expression.replace("NAMES", listed))


def with_maps(df: DataFrame, answer: str, names: list[str]) -> DataFrame:
    """``df`` with _maps: for each record of a plain answer its fields under these names (in any case) as strings; else null.

    Records are the objects of a list, or of the list under 'requirements' or else 'raw' of an object.
    """
    plain = F.when(~F.contains(F.col(answer), F.lit("```")), literal(F.col(answer)))
    out = df.withColumn("_value", plain).withColumn("_kind", F.schema_of_variant("_value"))
    inner = F.expr("if(_kind like 'OBJECT%', coalesce(try_element_at(cast(_value as map<string, variant>), 'requirements'), try_element_at(cast(_value as map<string, variant>), 'raw')), null)")
    out = out.withColumn("_inner", F.when(F.col("_kind").startswith("ARRAY"), F.col("_value")).otherwise(inner))
    out = out.withColumn("_list", F.expr("if(coalesce(schema_of_variant(_inner), '') like 'ARRAY%', cast(_inner as array<variant>), cast(array() as array<variant>))"))
    records = "transform(filter(_list, x -> schema_of_variant(x) like 'OBJECT%'), x -> map_filter(cast(x as map<string, variant>), (k, v) -> array_contains(NAMES, lower(k))))"
    out = out.withColumn("_records", _sql(records, names))
    # Other kinds of values, and names that differ in case only, are left to Python.
    simple = F.expr(
        f"forall(_records, m -> forall(map_values(m), v -> v is null or schema_of_variant(v) in {_SIMPLE})"
        " and size(array_distinct(transform(map_keys(m), k -> lower(k)))) = size(m))"
    )
    strings = F.expr(
        "transform(_records, m -> transform_values(m, (k, v) -> if(schema_of_variant(v) = 'BIGINT', nullif(cast(v as string), '0'), cast(v as string))))"
    )
    readable = F.col("_kind").isNotNull() & (F.col("_kind") != "VOID") & simple
    return out.withColumn("_maps", F.when(readable, strings)).drop("_value", "_kind", "_inner", "_list", "_records")


def plain_records(df: DataFrame, answer: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Records of the plain answers: the other columns of ``df``, item and a column for each alias. No Python."""
    mapped = with_maps(df, answer, [n for names in aliases.values() for n in names]).where("_maps is not null")
    rows = mapped.select(*[c for c in df.columns if c != answer], F.posexplode("_maps").alias("item", "_m"))
    return rows.select(*rows.columns[:-1], *[J.alias(F.col("_m"), names).alias(k) for k, names in aliases.items()])


def _reader(aliases: dict[str, list[str]]):
    fields = ", ".join(f"{k}: string" for k in aliases)

    @F.pandas_udf(f"struct<error: string, records: array<struct<{fields}>>>")
    def run(answers: pd.Series) -> pd.DataFrame:
        errors, records = [], []
        for text in answers:
            found = J.parse(text)
            records.append([{k: J.field(x, names) for k, names in aliases.items()} for x in J.items_of(found)])
            errors.append(None if found is not None else reason(text))
        return pd.DataFrame({"error": pd.Series(errors, dtype=object), "records": pd.Series(records, dtype=object)})

    return run


def reason(text: str | None) -> str:
    """Why a text is no JSON, read literally."""
    try:
        json.loads((text or "").strip())
    except ValueError as e:
        return str(e)
    return "the answer is null"


def records(answered: DataFrame, answer: str, aliases: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """The records of ``answered``, and its rows whose answer can't be read, with ``error``.

    ``answered`` is evaluated for each of them: write it first if that asks a model.
    """
    names = [n for x in aliases.values() for n in x]
    rest = with_maps(answered, answer, names).where("_maps is null").drop("_maps").withColumn("_read", _reader(aliases)(answer))
    failed = rest.where("_read.error is not null").select(*answered.columns, F.col("_read.error").alias("error"))
    others = [c for c in answered.columns if c != answer]
    tolerant = rest.select(*others, F.posexplode("_read.records").alias("item", "_r")).select(*others, "item", *[f"_r.{k}" for k in aliases])
    return plain_records(answered, answer, aliases).unionByName(tolerant), failed


def quarantine(failed: DataFrame, folder: str) -> int:
    """Appends answers that can't be read (columns and error) to a table below the folder; how many there were."""
    name = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/batch={name}"
    failed.write.parquet(path)
    return failed.sparkSession.read.schema(failed.schema).parquet(path).count()
