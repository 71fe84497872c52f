"""Model answers: the VARIANT path and the tolerant reader give the same records; what can't be read is kept."""

import json

import pytest

from tessella.functions import model_json as J
from tessella.operators import answers as A
from tessella.operators import requirements as R
from tessella.providers import RuleLLM

PLAIN = [
    '[{"text": "one", "section": "1"}, 7, null, {"Text": "two"}]', '{"requirements": [{"requirement": " x ", "text": "  "}]}', '{"raw": [{"text": "r"}]}',
    '{"requirements": null, "raw": [{"text": "no"}]}', '{"requirements": "none"}', "[]", "{}", "7", '"text"', ' [ {"text": "blank \\n around", "number": 12} ] ',
    '[{"text": 0, "content": "zero is passed over"}, {"text": null, "description": "é世"}, {"ТРЕБОВАНИЕ": "да", "пункт": "3"}]', '[{"other": {"a": [1.5]}, "text": "t"}]', "true",
]
ODD = [
    '[1] [{"text": "x"}]', '{"text": "a"} trailing', "nope", "", None, "null", '[{"text": NaN}]', '[{"text": 1.50, "section": true}]', '[{"text": ["a", 1]}]',
    '```json\n[{"text": "fenced"}]\n```', '["```", {"text": "lost"}]', '[{"text": "a", "TEXT": "b"}]', '{"a": 1, "a": 2, "raw": [{"text": "twice"}]}', '[{"text": "open"',
    '[{"text": "comma"},]', ' [{"text": "space"}]', '[{"text": 12345678901234567890123}]', '{"text": 1},{"text": 2}', "[1,2],[3]",
]


def by_python(text):
    return [tuple(J.field(x, names) for names in R.ALIASES.values()) for x in J.items_of(J.parse(text))]


def test_both_paths_agree(spark):
    frame = spark.createDataFrame(list(enumerate(PLAIN + ODD)), "id int, answer string").repartition(3)
    found, failed = A.records(frame, "answer", R.ALIASES)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r.item)):
        got.setdefault(r.id, []).append(tuple(r[k] for k in R.ALIASES))
    for i, text in enumerate(PLAIN + ODD):
        assert got.get(i, []) == by_python(text), text
    assert {r.answer for r in failed.collect()} == {t for t in PLAIN + ODD if J.parse(t) is None}
    errors = {r.answer: r.error for r in failed.collect()}
    assert errors["null"] == "the answer is null" and "Expecting value" in errors["nope"]


def test_plain_answers_stay_in_the_jvm(spark):
    frame = spark.createDataFrame(list(enumerate(PLAIN + ODD)), "id int, answer string")
    plain = A.plain_records(frame, "answer", R.ALIASES)
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString()
    taken = {r.id for r in A.with_maps(frame, "answer", [n for x in R.ALIASES.values() for n in x]).where("_maps is not null").collect()}
    assert taken == set(range(len(PLAIN)))


def test_no_answers(spark):
    frame = spark.createDataFrame([], "id int, answer string")
    found, failed = A.records(frame, "answer", R.ALIASES)
    assert found.isEmpty() and failed.isEmpty()


@pytest.mark.parametrize("again", [1, 2])
def test_failed_answers_can_be_read_back(spark, tmp_path, again):
    llm = RuleLLM(lambda p: "sorry" if "second" in p else json.dumps([{"text": "a requirement", "category": "SLA"}]))
    documents = spark.createDataFrame([("a", "first"), ("b", "second")], "document_name string, text string")
    for _ in range(again):
        found = R.extract_requirements(documents, llm, quarantine=f"{tmp_path}/q").collect()
    assert [(r.document_name, r.id, r.text, r.category) for r in found] == [("a", 1, "a requirement", "sla")]
    kept = spark.read.parquet(f"{tmp_path}/q").collect()
    assert [(r.document_name, r.answer) for r in kept] == [("b", "sorry")] * again and "Expecting value" in kept[0].error
