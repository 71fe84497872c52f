"""Providers over HTTP by the standard library: page fetcher, chat and embedding endpoints, web search.

Addresses are arguments; keys come from environment variables of the executors and are never kept.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.parse
import urllib.request

AGENT = "Mozilla/5.0 (compatible; tessella)"


def _get(url: str, timeout: float, data: bytes | None = None, headers: dict | None = None):
    request = urllib.request.Request(url, data, {"User-Agent": AGENT, **(headers or {})})
    return urllib.request.urlopen(request, timeout=timeout)


class HttpFetcher:
    """Pages as text; redirects are followed, errors raise, other content than text gives None.

    An answer longer than ``most_bytes`` raises: a page is held whole.
    """

    def __init__(self, timeout: float = 30.0, delay: float = 0.2, most_bytes: int = 64 << 20):
        self.timeout, self.delay, self.most_bytes = timeout, delay, most_bytes

    def fetch(self, url: str) -> str | None:
        time.sleep(self.delay)  # politeness, for each partition
        with _get(url, self.timeout) as answer:
            kind = answer.headers.get_content_type()
            if not re.match(r"text/|application/(xhtml\+)?xml", kind):
                return None
            body = answer.read(self.most_bytes + 1)
            if len(body) > self.most_bytes:
                raise ValueError(f"the answer is longer than {self.most_bytes} bytes")
            return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


class _Endpoint:
    def __init__(self, base: str, model: str, key_variable: str, timeout: float = 120.0):
        self.base, self.model, self.key_variable, self.timeout = base.rstrip("/"), model, key_variable, timeout

    @property
    def identity(self) -> str:
        """What an answer depends on, for the call ledger: neither key nor timeout."""
        settings = {k: v for k, v in sorted(vars(self).items()) if k not in ("key_variable", "timeout")}
        return f"{type(self).__name__}:{json.dumps(settings)}"

    def post(self, path: str, body: dict) -> dict:
        key = os.environ.get(self.key_variable)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with _get(f"{self.base}/{path}", self.timeout, json.dumps({"model": self.model, **body}).encode(), headers) as answer:
            return json.load(answer)


class ChatModel(_Endpoint):
    """Answers of a chat completion endpoint; an answer without content is ''."""

    def __init__(
        self, base: str, model: str, key_variable: str = "CHAT_API_KEY", system: str = "", temperature: float = 0.1,
        max_tokens: int = 4096, timeout: float = 120.0,
    ):
        super().__init__(base, model, key_variable, timeout)
        self.system, self.temperature, self.max_tokens = system, temperature, max_tokens

    def complete(self, prompts: list[str]) -> list[str]:
        first = [{"role": "system", "content": self.system}] if self.system else []
        settings = {"temperature": self.temperature, "max_tokens": self.max_tokens}
        answers = [self.post("chat/completions", {"messages": [*first, {"role": "user", "content": p}], **settings}) for p in prompts]
        return [(a.get("choices") or [{}])[0].get("message", {}).get("content") or "" for a in answers]


class EmbeddingModel(_Endpoint):
    """Vectors of an embedding endpoint, in the order of the texts."""

    def __init__(self, base: str, model: str, key_variable: str = "EMBEDDING_API_KEY", timeout: float = 120.0):
        super().__init__(base, model, key_variable, timeout)

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = sorted(self.post("embeddings", {"input": texts})["data"], key=lambda x: x["index"])
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [x["embedding"] for x in found]


class JsonWebSearch:
    """Web search by an endpoint that answers with a JSON list of objects with href, title and body.

    ``region`` (such as 'ru-ru') is passed on if given.
    """

    def __init__(self, address: str, timeout: float = 30.0, region: str | None = None):
        self.address, self.timeout, self.region = address, timeout, region

    @property
    def identity(self) -> str:
        return f"JsonWebSearch:{self.address}:{self.region}"

    def search(self, query: str, limit: int) -> list[dict]:
        asked = {"q": query, "limit": limit} | ({"region": self.region} if self.region else {})
        with _get(f"{self.address}?{urllib.parse.urlencode(asked)}", self.timeout) as answer:
            return [x for x in json.load(answer) if isinstance(x, dict)][:limit]
