"""Text expressions: everything here is a Catalyst expression, evaluated in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script (trim() knows spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def truncated(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def squeeze(c: Column) -> Column:
    """At most one blank line, no runs of spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")


def packed(c: Column, size: int) -> Column:
    """Paragraphs packed greedily to chunks of up to ``size`` characters, in one fold.

    Texts that fit are one chunk. A paragraph longer than ``size`` stays whole, blank starts of a
    chunk are dropped, and a long text of line ends only gives no chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        has = acc["open"] != ""
        full = has & (F.length(acc["open"]) + F.length(part) + 1 > size)
        grown = F.when(has, F.concat(acc["open"], F.lit("\n"), part)).otherwise(part)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full, part).otherwise(grown).alias("open"),
        )

    def end(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    folded = F.aggregate(F.split(c, "\n", -1), start, add, end)
    return F.when(F.length(c) <= size, F.array(c)).otherwise(folded)


def lowered(c: Column) -> Column:
    """Lower case by single code points, as in SQL engines: lower() makes two of the dotted capital I, which cut words in two."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def fallback_keywords(c: Column, n: int = 5) -> Column:
    """The first ``n`` different words of four letters or more, Cyrillic or Latin, in order of appearance."""
    found = F.regexp_extract_all(lowered(c), F.lit("([а-яёa-z]{4,})"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, n)


def listed_keywords(c: Column, n: int = 5) -> Column:
    """Keywords from a model's comma-separated answer."""
    parts = F.transform(F.split(c, ","), lambda k: F.lower(strip(k)))
    return F.slice(F.filter(parts, lambda k: k != ""), 1, n)


def keyword_key(c: Column) -> Column:
    return F.translate(lowered(c), " -", "")


def path_key(c: Column) -> Column:
    return F.translate(F.translate(c, "-_", ""), "/", " ")


def url_path(url: Column, root: str) -> Column:
    return lowered(F.replace(url, F.lit(root), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def trusted(url: Column, domains: Iterable[str]) -> Column:
    """Whether the host is one of the domains or below one; junk is not trusted."""
    h = host(url)
    known = F.array(*[F.lit(d) for d in domains])
    return F.coalesce(F.exists(known, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))), F.lit(False))


def trusted_links(urls: Column, domains: Iterable[str]) -> Column:
    """Trusted http links of an array; order and repeats stay, a null array becomes empty."""
    domains = tuple(domains)
    kept = F.filter(urls, lambda u: F.startswith(u, F.lit("http")) & trusted(u, domains))
    return F.coalesce(kept, F.array().cast("array<string>"))


def merged_links(first: Column, second: Column) -> Column:
    """Both arrays in order, each link once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))


def short_url(url: Column, docs_base: str) -> Column:
    """A label for a link: first and last telling parts of its path."""
    path = F.regexp_replace(F.replace(url, F.lit(docs_base.rstrip("/") + "/"), F.lit("")), "/+$", "")
    noise = F.array(*[F.lit(x) for x in ("ug", "topics", "index", "index.html")])
    parts = F.filter(F.split(path, "/"), lambda p: ~F.array_contains(noise, p))
    return (
        F.when(F.size(parts) > 2, F.concat(F.element_at(parts, 1), F.lit(" / "), F.element_at(parts, -1)))
        .when(F.size(parts) > 0, F.array_join(parts, " / "))
        .otherwise(url)
    )


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def pdf_safe(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\r"), F.lit("")))


def cache_key(url: Column) -> Column:
    return F.md5(url)


def percent(confidence: Column) -> Column:
    return F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))


def table_markdown(headers: Column, rows: Column) -> Column:
    """A markdown table; missing headers become Col0, Col1, ...; rows are padded or cut to the width."""
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.size(F.try_element_at(rows, F.lit(1))))
    made = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("Col"), i.cast("string")))
    names = F.when(F.size(headers) > 0, headers).otherwise(made)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    places = F.sequence(F.lit(1), width)
    fitted = F.transform(
        rows, lambda r: line(F.transform(places, lambda i: F.coalesce(F.try_element_at(r, i), F.lit(""))))
    )
    whole = F.concat(F.array(line(names), line(F.transform(places, lambda i: F.lit("---")))), fitted)
    empty = (F.size(headers) <= 0) & (F.size(rows) <= 0)
    return F.when(empty, F.lit("")).otherwise(F.array_join(whole, "\n"))


def full_text(text: Column, tables: Column) -> Column:
    """A parsed document's text with its tables after it."""
    return F.array_join(
        F.concat(
            F.array(text),
            F.transform(
                tables,
                lambda t: F.concat(
                    F.lit("\n[Таблица из "), t["page_or_section"], F.lit("]\n"), table_markdown(t["headers"], t["rows"])
                ),
            ),
        ),
        "\n",
    )


def page_title(html: Column) -> Column:
    """The first h1, even if it is empty, else the title; markup inside is dropped."""
    take = lambda tag: strip(
        F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), "<[^>]*>", "")
    )
    return F.when(F.rlike(html, F.lit(r"(?i)<h1[\s>]")), take("h1")).otherwise(take("title"))


def crumbs(found: Column, title: Column) -> Column:
    """Breadcrumbs with the title at the end, unless it stands there."""
    last = F.try_element_at(found, F.lit(-1))
    return F.when((title != "") & ~F.coalesce(last == title, F.lit(False)), F.array_append(found, title)).otherwise(found)


def messages(system: Column, user: Column) -> Column:
    """Chat messages; a blank system text is left out."""
    some = F.when(F.coalesce(system, F.lit("")) != "", F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.filter(
        F.array(some, F.struct(F.lit("user").alias("role"), user.alias("content"))), lambda m: m.isNotNull()
    )
