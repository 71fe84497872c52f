"""Reports: markdown as an ordered aggregation of lines, office files by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators import verdicts as V

_MARK = {"mismatch": ("Несоответствия", "Причина"), "needs_clarification": ("Требуют уточнения", "Комментарий"), "partial": ("Частичное соответствие", "Обоснование")}


def _links(config: EngineConfig) -> Column:
    named = F.transform(
        F.slice("source_urls", 1, 5), lambda u: F.concat(F.lit("["), T.short_url(u, config.docs_base), F.lit("]("), u, F.lit(")"))
    )
    return F.nullif(F.array_join(named, ", "), F.lit(""))


def _line(*parts) -> Column:
    """Text of the parts; null if one of them is, and then the line is left out."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _some(c: str) -> Column:
    return F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))


def _entry(config: EngineConfig, reason: Column) -> Column:
    category = V.lookup(V.CATEGORY_LABELS, F.col("category"), F.col("category"))
    lines = [
        _line("### ", V.section_label(F.col("section"), F.col("requirement_id")), " (", category, ")"),
        _line("**Пункт / раздел в ТЗ:** ", V.point(F.col("section"), F.col("requirement_id"))),
        _line("**Требование:** ", V.requirement_text(F.col("requirement_text"), F.col("reasoning"))),
        reason,
        F.when(F.col("verdict") != "match", _line("**Рекомендация:** ", _some("recommendation"))),
        _line("**Документация:** ", _links(config)),
        F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def markdown(verdicts: DataFrame, generated_at: Column, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None) -> DataFrame:
    """One markdown text for each document (document_name, markdown).

    Details stand in order of requirement id; categories without a label are left out there.
    """
    m = V.metrics(verdicts)
    m = m.join(summaries.select("document_name", "summary"), "document_name", "left") if summaries is not None else m.withColumn("summary", F.lit(None).cast("string"))
    pct, score, most = F.col("compliance_percentage").cast("string"), F.col("score").cast("string"), F.col("max_score").cast("string")
    number = lambda c: F.col(c).cast("string")
    counts = (("match", "Соответствует", "match_count"), ("partial", "Частично", "partial_count"), ("mismatch", "Не соответствует", "mismatch_count"), ("needs_clarification", "Требует уточнения", "clarification_count"))
    head = F.concat_ws(
        "\n",
        _line("# Отчёт по анализу ТЗ: ", F.col("document_name")),
        _line("*Дата анализа: ", F.date_format(generated_at, "dd.MM.yyyy HH:mm"), "*\n"),
        _line("## Общий процент соответствия: ", pct, "%"),
        _line("**", score, " из ", most, " баллов**\n"),
        _line("**Быстрый вывод:** ", V.decision(), "\n"),
        F.lit("### Методика оценки\n\n| Вердикт | Баллы |\n|---|---|\n| Полное соответствие | 2 |\n| Частичное соответствие | 1 |\n| Несоответствие / Требует уточнения | 0 |\n"),
        _line("Максимальный балл = ", number("total"), " пунктов × 2 = ", most, ". Набрано ", score, " баллов. Итоговый процент = ", score, " / ", most, " × 100 = **", pct, "%**\n"),
        F.lit("## Сводка\n\n| Показатель | Значение |\n|---|---|"),
        _line("| Всего требований | ", number("total"), " |"),
        *[_line(f"| {V.VERDICT_ICONS[v]} {label} | ", number(c), " |") for v, label, c in counts],
        _line("| **Баллы** | **", score, " / ", most, "** |"),
        _line("| **Общее соответствие** | **", pct, "%** |\n"),
        _line("### Резюме\n\n", _some("summary"), "\n"),
        F.lit("## Что проверить в первую очередь\n"),
        _line("- Несоответствия: **", number("mismatch_count"), "**"),
        _line("- Требуют уточнения: **", number("clarification_count"), "**"),
        _line("- Частичные соответствия: **", number("partial_count"), "**\n"),
    )
    parts = [m.select("document_name", F.lit(0).alias("part"), F.lit(0).alias("row"), head.alias("line"))]
    ranked = V.ranked(verdicts, "document_name", "verdict")
    for i, (verdict, (title, label)) in enumerate(_MARK.items(), 1):
        reason = _line(f"**{label}:** ", F.coalesce(_some("reasoning"), F.lit(V.BY_HAND)))
        rows = ranked.where(F.col("verdict") == verdict)
        entry = F.concat(F.when(F.col("rank") == 1, F.lit(f"## {title}\n\n")).otherwise(""), _entry(config, reason))
        parts.append(rows.select("document_name", F.lit(i).alias("part"), F.col("rank").alias("row"), entry.alias("line")))
    best = V.key_matches(verdicts, "document_name", limit=config.key_matches).join(m.select("document_name", "match_count"), "document_name")
    shown = F.least(F.col("match_count"), F.lit(config.key_matches)).cast("string")
    title = _line("## Подтверждённые важные соответствия\n\nПоказаны только наиболее значимые подтверждённые пункты: ", shown, " из ", number("match_count"), ".\n\n")
    entry = F.concat(F.when(F.col("rank") == 1, title).otherwise(""), _entry(config, _line("**Почему соответствует:** ", _some("reasoning"))))
    parts.append(best.select("document_name", F.lit(4).alias("part"), F.col("rank").alias("row"), entry.alias("line")))
    parts.append(m.select("document_name", F.lit(5).alias("part"), F.lit(0).alias("row"), F.lit("## Детализация по всем требованиям\n").alias("line")))
    known = verdicts.where(F.col("category").isin(*V.CATEGORY_PRIORITY)).withColumn("order", V.lookup(V.CATEGORY_PRIORITY, F.col("category"), F.lit(9)))
    first = known.groupBy("document_name", "order", "category").agg(F.min("requirement_id").alias("id"))
    heading = _line("### ", V.lookup(V.CATEGORY_LABELS, F.col("category"), F.col("category")), "\n")
    parts.append(first.select("document_name", (F.col("order") + 6).alias("part"), F.lit(-1).alias("row"), heading.alias("line")))
    detail = F.concat_ws(
        "\n",
        _line("**", V.section_label(F.col("section"), F.col("requirement_id")), "** ", V.lookup(V.VERDICT_ICONS, F.col("verdict"), F.lit("")), " ", V.lookup(V.VERDICT_LABELS, F.col("verdict"), F.col("verdict")), " (уверенность: ", T.percent(F.col("confidence")), ")"),
        _line("> ", V.requirement_text(F.col("requirement_text"), F.col("reasoning"))),
        _line("\n*Обоснование:* ", _some("reasoning")),
        _line("\n*Источник:* ", _some("evidence")),
        _line("\n*Документация:* ", _links(config)),
        _line("\n*Рекомендация:* ", _some("recommendation")),
        F.lit(""),
    )
    parts.append(known.select("document_name", (F.col("order") + 6).alias("part"), F.col("requirement_id").alias("row"), detail.alias("line")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "row", "line"))), lambda x: x["line"])
    return every.groupBy("document_name").agg(F.array_join(lines, "\n").alias("markdown"))


def file_name(document: str, stamp: str, suffix: str) -> str:
    safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in document)
    return f"report_{safe}_{stamp}.{suffix}"


# Office files: a document's report is small by nature, and is rendered where its rows are grouped.

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _xml(text) -> str:
    return escape(_CONTROL.sub("", str(text)))


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx_bytes(blocks: Iterable[tuple[str, object]]) -> bytes:
    """A document of ('h0' | 'h1' | 'h2' | 'p' | 'b', text) and ('t', rows) blocks."""

    def paragraph(text: str, bold: bool = False, size: int = 0) -> str:
        style = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
        runs = '</w:t><w:br/><w:t xml:space="preserve">'.join(_xml(text).split("\n"))
        return f'<w:p><w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">{runs}</w:t></w:r></w:p>'

    body = []
    for kind, value in blocks:
        if kind == "t":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in value)
            edges = "".join(f'<w:{e} w:val="single" w:sz="4"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
            body.append(f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr>{rows}</w:tbl>")
        else:
            body.append(paragraph(value, kind != "p", {"h0": 52, "h1": 32, "h2": 26, "b": 36}.get(kind, 0)))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return _zip({
        "[Content_Types].xml": _TYPES.format('<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'),
        "_rels/.rels": _RELS.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/>'),
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>',
    })


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook; columns are as wide as their longest cell and 2 more, 60 at most."""

    def name(i: int) -> str:
        return (name(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def cell(ref: str, v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_xml("" if v is None else v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    files, links, entries, types = {}, [], [], []
    for n, (title, rows) in enumerate(sheets.items(), 1):
        width = max(map(len, rows), default=0)
        sizes = [min(60, 2 + max(len(str(r[i] if r[i] is not None else "")) for r in rows if len(r) > i)) for i in range(width)]
        cols = "".join(f'<col min="{i}" max="{i}" width="{s}" customWidth="1"/>' for i, s in enumerate(sizes, 1))
        data = "".join(f'<row r="{i}">' + "".join(cell(f"{name(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{n}.xml"] = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{main}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{data}</sheetData></worksheet>'
        links.append(f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>')
        entries.append(f'<sheet name="{_xml(title[:31])}" sheetId="{n}" r:id="rId{n}"/>')
        types.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    book = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    return _zip({
        "[Content_Types].xml": _TYPES.format(book + "".join(types)),
        "_rels/.rels": _RELS.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'),
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{main}" xmlns:r="{_OFFICE}"><sheets>{"".join(entries)}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _RELS.format("".join(links)),
        **files,
    })


_COUNTS = (
    ("Всего требований", "total"), ("Соответствует", "match_count"), ("Частично", "partial_count"),
    ("Не соответствует", "mismatch_count"), ("Требует уточнения", "clarification_count"),
)
_METHOD = [("Полное соответствие", "2"), ("Частичное соответствие", "1"), ("Несоответствие / Требует уточнения", "0")]


def report_columns(verdicts: DataFrame) -> DataFrame:
    """What office reports print of each verdict, ranked within its document and verdict."""
    return V.ranked(verdicts, "document_name", "verdict").select(
        "document_name", "requirement_id", "verdict", "rank",
        V.point(F.col("section"), F.col("requirement_id")).alias("point"),
        V.lookup(V.CATEGORY_LABELS, F.col("category"), F.col("category")).alias("category"),
        V.lookup(V.VERDICT_LABELS, F.col("verdict"), F.col("verdict")).alias("label"),
        V.points(F.col("verdict")).alias("points"),
        T.percent(F.col("confidence")).alias("confidence"),
        V.requirement_text(F.col("requirement_text"), F.col("reasoning"), 150).alias("text150"),
        V.requirement_text(F.col("requirement_text"), F.col("reasoning"), 300).alias("text300"),
        V.requirement_text(F.col("requirement_text"), F.col("reasoning"), 1000).alias("text1000"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
        F.array_join(F.slice("source_urls", 1, 5), "\n").alias("links"),
    )


def render_docx(m: dict, rows: list[dict], when: str, key_matches: int = 10) -> bytes:
    pct = m["compliance_percentage"]
    blocks: list = [
        ("h0", f"Отчёт по анализу ТЗ: {m['document_name']}"), ("p", f"Дата анализа: {when}"),
        ("b", f"Общий процент соответствия: {pct}%"), ("b", f"{m['score']} из {m['max_score']} баллов"),
        ("h2", "Методика оценки"), ("t", [("Вердикт", "Баллы"), *_METHOD]),
        ("p", f"Максимальный балл = {m['total']} пунктов × 2 = {m['max_score']}. Набрано {m['score']} баллов. Итоговый процент = {m['score']} / {m['max_score']} × 100 = {pct}%"),
        ("h1", "Сводка"),
        ("t", [("Показатель", "Значение"), *((t, str(m[c])) for t, c in _COUNTS), ("Баллы", f"{m['score']} / {m['max_score']}"), ("Общее соответствие", f"{pct}%")]),
    ]
    if m.get("summary"):
        blocks += [("h2", "Резюме"), ("p", m["summary"])]
    blocks += [("h1", "Что проверить в первую очередь"), ("p", m["decision"])]
    full = ["Пункт ТЗ", "Категория", "Требование", None, "Рекомендация", "Документация"]
    for verdict, (title, label) in _MARK.items():
        some = [r for r in rows if r["verdict"] == verdict]
        short = verdict == "needs_clarification"
        if some:
            heads = [label if h is None else h for h in (full[:4] if short else full)]
            cells = [[r["point"], r["category"], r["text150"], r["reasoning"], *(() if short else (r["recommendation"], r["links"]))] for r in some]
            blocks += [("h1", title), ("t", [heads, *cells])]
    best = [r for r in rows if r["verdict"] == "match"][:key_matches]
    if best:
        blocks += [("h1", "Подтверждённые важные соответствия"), ("t", [["Пункт ТЗ", "Категория", "Требование", "Документация"], *([r["point"], r["category"], r["text150"], r["links"]] for r in best)])]
    return docx_bytes(blocks)


def render_xlsx(m: dict, rows: list[dict]) -> bytes:
    rows = sorted(rows, key=lambda r: r["requirement_id"])
    heads = ["Пункт ТЗ", "Текст требования", "Категория", "Вердикт", "Баллы", "Уверенность", "Обоснование", "Источник (цитата)", "Рекомендация", "Ссылки на документацию"]
    names = ("point", "text1000", "category", "label", "points", "confidence", "reasoning", "evidence", "recommendation", "links")
    summary = [["Показатель", "Значение"], *([t, m[c]] for t, c in _COUNTS), ["Баллы", f"{m['score']} / {m['max_score']}"], ["Общее соответствие", f"{m['compliance_percentage']}%"], ["", ""], ["Методика оценки", ""], ["Полное соответствие", "2 балла"], ["Частичное соответствие", "1 балл"], ["Несоответствие / Требует уточнения", "0 баллов"]]
    sheets = {"Сводка": summary, "Все требования": [heads, *([r[n] for n in names] for r in rows)]}
    for label in V.VERDICT_LABELS.values():
        some = [[r[n] for n in names] for r in rows if r["label"] == label]
        if some:
            sheets[label[:31]] = [heads, *some]
    return xlsx_bytes(sheets)


def render_pdf(m: dict, rows: list[dict], when: str) -> bytes:
    """A PDF by the optional library; without it, an error rather than an empty file."""
    try:
        from fpdf import FPDF
    except ImportError:
        raise ValueError("PDF writer not installed") from None
    pdf = FPDF()
    pdf.add_page()
    pdf.set_font("Helvetica", size=11)
    for line in (f"{m['document_name']} ({when})", f"{m['compliance_percentage']}% ({m['score']} / {m['max_score']})", m["decision"]):
        pdf.multi_cell(0, 6, line.replace("\r", "").strip())
    for r in rows:
        pdf.multi_cell(0, 6, f"{r['point']} {r['label']}: {r['text300']}")
    return bytes(pdf.output())


RENDERERS = {
    "docx": render_docx,
    "xlsx": lambda m, rows, when: render_xlsx(m, rows),
    "pdf": render_pdf,
}


def office(verdicts: DataFrame, kind: str, generated_at: Column, summaries: DataFrame | None = None) -> DataFrame:
    """Files (document_name, file_name, content) of a kind, one for each document."""
    if kind not in RENDERERS:
        raise ValueError(f"unknown format {kind!r}")
    rows = report_columns(verdicts)
    packed = rows.groupBy("document_name").agg(F.array_sort(F.collect_list(F.struct("verdict", "rank", *[c for c in rows.columns if c not in ("verdict", "rank", "document_name")]))).alias("rows"))
    m = V.metrics(verdicts).withColumn("decision", V.decision())
    m = m.join(summaries.select("document_name", "summary"), "document_name", "left") if summaries is not None else m
    both = m.join(packed, "document_name").select(
        "document_name", F.struct(*m.columns).alias("m"), "rows",
        F.date_format(generated_at, "dd.MM.yyyy HH:mm").alias("at"), F.date_format(generated_at, "yyyyMMdd_HHmmss").alias("stamp"),
    )
    render = RENDERERS[kind]

    @F.udf("struct<file_name: string, content: binary>")
    def made(name, m, rows, at, stamp):
        return file_name(name, stamp, kind), render(m.asDict(), [r.asDict() for r in rows], at)

    return both.select("document_name", made("document_name", "m", "rows", "at", "stamp").alias("f")).select("document_name", "f.*")
