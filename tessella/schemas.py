"""Fixed schemas of the engine's tables, as Spark DDL."""

TABLE = "struct<page_or_section: string, headers: array<string>, rows: array<array<string>>>"
REQUIREMENT = "document_name string, id int, section string, text string, category string, tables string"
VERDICT = (
    "document_name string, requirement_id int, section string, requirement_text string, category string, "
    "verdict string, confidence double, reasoning string, evidence string, recommendation string, "
    "source_urls array<string>"
)
VERDICT_ITEM = (
    "requirement_id: int, verdict: string, confidence: double, reasoning: string, evidence: string, "
    "source_urls: array<string>, recommendation: string"
)
PARSED_DOCUMENT = f"filename string, text string, tables array<{TABLE}>, metadata map<string, string>, error string"
CRAWLED_PAGE = "url string, title string, breadcrumbs array<string>, content string, section_path string"
SEARCH_RESULT = (
    "requirement_id int, rank int, url string, title string, snippet string, content string, source_type string"
)
CHUNK = "chunk_id string, doc_key string, pos int, text string, metadata map<string, string>, embedding array<float>"
