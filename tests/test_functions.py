"""Edge cases worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import chunk, html, model_json
from tessella.functions import text as T


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        ("abcd", 4, ["abcd"]),
        ("aaaaaaaa\nb", 4, ["aaaaaaaa", "b"]),
        ("\n\nabcd", 4, ["abcd"]),
        ("\n\n\n", 2, []),
        ("ab\ncd\nef", 5, ["ab\ncd", "ef"]),
    ],
)
def test_packed(spark, text, size, want):
    assert one(spark, T.packed(F.col("t"), size), t=text) == want


def test_keywords(spark):
    words = one(spark, T.fallback_keywords(F.col("t")), t="Шифрование AES-256 и api2go данных")
    assert words == ["шифрование", "данных"]
    assert one(spark, T.listed_keywords(F.col("t")), t=" VPC, ,API Gateway ,a,b,c,d") == ["vpc", "api gateway", "a", "b", "c"]


def test_hosts(spark):
    domains = ("b.example",)
    for url, want in (("https://a.b.example/x", True), ("https://xb.example", False), ("https://B.EXAMPLE", True), ("junk", False)):
        assert one(spark, T.trusted(F.col("u"), domains), u=url) is want
    assert one(spark, T.trusted_links(F.col("u"), domains), u=["ftp://b.example", "http://b.example/1", "x"]) == ["http://b.example/1"]


def test_links(spark):
    base = "https://example.com/docs"
    for url, want in (
        (base + "/s3e/ug/topics/overview.html", "s3e / overview.html"),
        ("a/b", "a / b"),
        ("index.html", "index.html"),
        ("https://other.example/x/y", "https: / y"),
    ):
        assert one(spark, T.short_url(F.col("u"), base), u=url) == want
    merged = one(spark, T.merged_links(F.col("a"), F.col("b")), a=["b", "a"], b=["a", "c"])
    assert merged == ["b", "a", "c"]


def test_table_markdown(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], [["1", "2"], ["1", "2", "3", "4"]]), ([], [["x", "y"]]), ([], [])], "h array<string>, r array<array<string>>")
    got = [r.x for r in frame.select(T.table_markdown(F.col("h"), F.col("r")).alias("x")).collect()]
    assert got[0].split("\n")[2:] == ["| 1 | 2 |  |", "| 1 | 2 | 3 |"]
    assert got[1].split("\n")[0] == "| Col0 | Col1 |"
    assert got[2] == ""


def test_strip_and_messages(spark):
    assert one(spark, T.strip(F.col("t")), t="\u00a0\n a b \u2003") == "a b"
    assert [m.role for m in one(spark, T.messages(F.lit(""), F.lit("hi")))] == ["user"]
    assert [m.role for m in one(spark, T.messages(F.lit("s"), F.lit("hi")))] == ["system", "user"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x ```json\n[1, 2]\n``` y", [1, 2]),
        ("so [1,2] it is", [1, 2]),
        ('{"a":1,}', {"a": 1}),
        ("[1,2", [1, 2]),
        ("nope", None),
        ("[1] and [2]", None),
        (None, None),
    ],
)
def test_json(text, want):
    assert model_json.parse(text) == want


def test_json_accepts_nan():
    assert model_json.parse('{"a": NaN}')["a"] != model_json.parse('{"a": NaN}')["a"]


def test_fields():
    assert model_json.field({"Text": "x"}, ["text"]) == "x"
    assert model_json.field({"text": "  ", "content": "y"}, ["text", "content"]) == "y"
    assert model_json.items_of({"requirements": [{"a": 1}, 2]}) == [{"a": 1}]
    assert model_json.items_of({"raw": "words"}) == []


def test_alias(spark):
    frame = spark.createDataFrame([({"Text": " x "},), ({"text": " ", "CONTENT": "y"},), ({},)], "m map<string, string>")
    assert [r.x for r in frame.select(model_json.alias(F.col("m"), ["text", "content"]).alias("x")).collect()] == ["x", "y", ""]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=2500))
def test_splitter(text):
    parts = chunk.split(text)
    assert all(0 < len(p) <= 500 for p in parts)
    squeezed = "".join(text.split())
    at = 0
    for p in parts:  # in order, without gaps
        p = "".join(p.split())
        found = squeezed.rfind(p, 0, at + len(p))
        assert found >= 0
        at = max(at, found + len(p))
    assert at == len(squeezed)


def test_html():
    plain = "<main><h2>A</h2><p>x <b>y</b> z</p></main>"
    assert html.page(plain, parity=True)["content"] == "## A\nA\nxyz"
    assert html.page(plain)["content"] == "## A\n\nx y z"
    assert html.page("<title>t</title><h1></h1>")["title"] == ""
    assert html.page(None)["content"] == ""
    trail = html.page('<nav class="Breadcrumbs"><a>Docs</a><a> </a></nav><h1>T</h1><article><p>b</article>')
    assert trail["section_path"] == "Docs / T" and trail["content"] == "b"
    body = html.page('<main>s</main><script>{"pageData":{"body":"<p>long \\u0041</p>"}}</script>')
    assert body["content"] == "s\n\nlong A"
    skipped = html.page("<main><script>no</script><ul><li>a<li>b</ul>1 &amp; 2</main>")["content"]
    assert "no" not in skipped and "- a" in skipped and "1 & 2" in skipped
