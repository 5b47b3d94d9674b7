"""Fetching a body over HTTP within fixed limits; the standard library's client, injected where bodies are fetched."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

#: Bytes of a body, seconds in all, redirects.
MOST_BYTES, MOST_SECONDS, MOST_REDIRECTS = 25 * 1024 * 1024, 30.0, 5
_SECRET = {"authorization", "cookie", "proxy-authorization", "x-api-key"}


class FetchError(Exception):
    """What went wrong, as a reason and nothing of the request."""

    def __init__(self, reason: str, status: int | None = None) -> None:
        super().__init__(reason)
        self.reason, self.status = reason, status


@dataclass(frozen=True)
class Fetched:
    body: bytes
    final_url: str
    status: int = 200
    content_type: str = ""


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_) -> None:
        return None


@dataclass(frozen=True)
class HttpFetcher:
    """GET with ``headers``; redirects are followed by hand, and secret headers stay with the first host."""

    headers: dict[str, str] = field(default_factory=dict)
    most_bytes: int = MOST_BYTES
    most_seconds: float = MOST_SECONDS
    most_redirects: int = MOST_REDIRECTS

    def __call__(self, url: str) -> Fetched:
        until, at, headers = time.monotonic() + self.most_seconds, url, dict(self.headers)
        opener = urllib.request.build_opener(_NoRedirect)
        for _ in range(self.most_redirects + 1):
            if urllib.parse.urlsplit(at).scheme not in ("http", "https"):
                raise FetchError("invalid_url")
            try:
                with opener.open(urllib.request.Request(at, headers=headers), timeout=max(0.01, until - time.monotonic())) as answer:
                    return Fetched(self._body(answer, until), at, answer.status, answer.headers.get("Content-Type", ""))
            except urllib.error.HTTPError as error:
                place = error.headers.get("Location")
                if error.code not in (301, 302, 303, 307, 308) or not place:
                    raise FetchError("http_error", error.code) from None
            except (TimeoutError, urllib.error.URLError) as error:
                raise FetchError("timeout" if isinstance(getattr(error, "reason", error), TimeoutError) else "network_error") from None
            onward = urllib.parse.urljoin(at, place)
            if urllib.parse.urlsplit(onward).netloc.lower() != urllib.parse.urlsplit(at).netloc.lower():
                headers = {k: v for k, v in headers.items() if k.lower() not in _SECRET}
            at = onward
        raise FetchError("too_many_redirects")

    def _body(self, answer, until: float) -> bytes:
        parts, size = [], 0
        while part := answer.read(1 << 16):
            size += len(part)
            if size > self.most_bytes:
                raise FetchError("content_too_large", answer.status)
            if time.monotonic() > until:
                raise FetchError("timeout", answer.status)
            parts.append(part)
        return b"".join(parts)


Fetcher = Callable[[str], "Fetched | bytes"]
