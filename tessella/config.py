"""Immutable engine settings. Credentials are read by providers from the environment, never stored here."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

#: Requirement categories, verdicts and where search results come from.
CATEGORIES = ("technical", "sla", "legal", "commercial", "security", "other")
VERDICTS = ("match", "partial", "mismatch", "needs_clarification")
SOURCE_TYPES = ("cloud_docs", "cloud_documents", "web", "rag_fallback")

#: Regulators and law databases that searches trust besides the site itself.
REGULATORS = (
    "fstec.ru",
    "rkn.gov.ru",
    "roskomnadzor.gov.ru",
    "consultant.ru",
    "garant.ru",
    "publication.pravo.gov.ru",
)


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a deployment; ``with_overrides`` makes a changed copy."""

    site_domains: tuple[str, ...] = ("example.com", "example.org")
    link_domains: tuple[str, ...] = ("example.com", "example.org", "example.net")
    site_root: str = "https://example.com/"
    docs_base: str = "https://example.com/docs"
    documents_base: str = "https://example.com/documents"
    sitemap_url: str = "https://example.com/docs/sitemap.xml"
    chunk_size: int = 500
    chunk_overlap: int = 80
    top_k: int = 5
    requirements_per_batch: int = 10
    embedding_batch: int = 50
    extraction_chunk: int = 6000
    context_chars: int = 2000
    snippet_chars: int = 300
    min_content: int = 50
    key_matches: int = 10
    crawl_max_pages: int = 0
    crawl_concurrency: int = 10
    embedding_dim: int = 64
    embedding_model: str = "hashing-64"

    @property
    def trusted_domains(self) -> tuple[str, ...]:
        """Whose web results count."""
        return self.site_domains + REGULATORS

    def with_overrides(self, **settings) -> EngineConfig:
        """Non-empty settings replace the present ones; unknown names raise."""
        return dataclasses.replace(self, **{k: v for k, v in settings.items() if v not in (None, "")})

    def same_index(self, other: EngineConfig) -> bool:
        """Whether vectors made under the other settings can be searched under these."""
        return (self.embedding_model, self.embedding_dim) == (other.embedding_model, other.embedding_dim)
