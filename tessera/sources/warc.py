"""WARC records inside a task."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa

_SKIP = frozenset("script style noscript template nav header footer aside form".split())
_BREAK = frozenset("p div li br h1 h2 h3 h4 article section td tr blockquote".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.in_title, self.parts = 0, [], False, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIP
        self.in_title = tag == "title"
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in _SKIP))
        self.in_title = False
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


def html_text(html: str) -> tuple[str, str]:
    """(title, text) of a page; paragraphs are lines."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return re.sub(r"\s+", " ", "".join(p.title)).strip(), "\n".join(x for x in lines if x)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of an open WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names="file url title body language_header seendate".split())


_IMAGE = re.compile(r"""<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)""", re.IGNORECASE)


def parse_pages(min_chars: int) -> Callable:
    """(page_id, url, title_html, html) to (page_id, url, title, title_html, body, image), pages with too little text left out."""

    def go(batches):
        for b in batches:
            rows = []
            for page_id, url, title_html, html in zip(*(c.to_pylist() for c in b.columns)):
                title, text = html_text(html or "")
                if len(text) >= min_chars:
                    image = _IMAGE.search(html or "")
                    rows.append((page_id, url, title, title_html, text, image and image[1]))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], names="page_id url title title_html body image".split())

    return go


def parse_files(min_chars: int, limit: int) -> Callable:
    def go(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = pa.BufferReader(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                rows, found = [], 0
                for head, body in records(stream):
                    if head.get("warc-type") != "response" or not head.get("warc-target-uri"):
                        continue
                    http, _, page = body.partition(b"\r\n\r\n")
                    if b"text/html" not in http.lower():
                        continue
                    title, text = html_text(page.decode("utf-8", "replace"))
                    if len(text) >= min_chars:
                        found += 1
                        rows.append((path, head["warc-target-uri"], title, text, head.get("warc-identified-content-language", ""), head.get("warc-date", "")))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                    if limit and found >= limit:
                        break
                if rows:
                    yield _batch(rows)

    return go
