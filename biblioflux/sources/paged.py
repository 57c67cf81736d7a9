"""A Python data source over paged services, with retries inside the reader: one partition per range of pages where the total is
known beforehand, one partition in sequence where each page leads to the next."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """(status, body) of a URL; file: URLs work, a missing file is status 404."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return getattr(r, "status", None) or 200, r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            return 404, ""
        raise


def fetch_with_retry(url: str, retries: int = 3, delay: float = 2.0, get=fetch, sleep=time.sleep) -> str | None:
    """The body; None for 404. Status 429 waits ever longer, other failures wait ``delay``; after the last try it raises, so that
    a lost page is never taken for an empty one."""
    for attempt in range(retries):
        try:
            status, body = get(url)
        except OSError:
            if attempt == retries - 1:
                raise
            sleep(delay)
            continue
        if status == 404:
            return None
        if status < 400:
            return body
        sleep(delay * 2**attempt if status == 429 else delay)
    raise RuntimeError(f"no answer after {retries} tries")


def items_at(body: str, path: str) -> list:
    """The list under a dotted path of a JSON body; empty if it isn't there."""
    node = _at(json.loads(body), path)
    return node if isinstance(node, list) else []


def _at(node, path: str):
    for key in filter(None, path.split(".")):
        node = node.get(key) if isinstance(node, dict) else None
    return node


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.path = options.get("items", "")
        self.total = int(options["total"]) if "total" in options else None
        self.next, self.token, self.first_url = options.get("next"), options.get("first", ""), options.get("firsturl", self.url)
        self.missing = options.get("missing", "fail" if self.total is None else "empty")
        if self.missing not in ("fail", "empty") or self.next and self.total is not None:
            raise ValueError("missing is fail or empty, and next goes without total")
        self.size = int(options.get("pagesize", "100"))
        self.start = int(options.get("start", "0"))
        self.per_task = int(options.get("pagespertask", "20"))
        self.retries, self.delay = int(options.get("retries", "3")), float(options.get("delay", "2"))
        self.pause = float(options.get("pause", "0"))

    def partitions(self) -> list[InputPartition]:
        if self.total is None:
            return [Pages(0, -1)]
        pages = -(-self.total // self.size)
        return [Pages(k, min(k + self.per_task, pages)) for k in range(0, pages, self.per_task)]

    def body(self, page: int, token: str = "") -> str | None:
        url = self.url if page else self.first_url
        at = url.format(offset=self.start + page * self.size, size=self.size, page=page, token=urllib.parse.quote(token, safe=""))
        body = fetch_with_retry(at, self.retries, self.delay)
        if body is None and self.missing == "fail":
            raise RuntimeError(f"page {page} isn't there")
        return body

    def read(self, partition: Pages) -> Iterator[tuple[int, int, str]]:
        if self.total is None:
            yield from self.read_on()
            return
        for page in range(partition.first, partition.last):
            body = self.body(page)
            items = items_at(body, self.path) if body else []
            for pos, item in enumerate(items):
                yield page, pos, json.dumps(item, ensure_ascii=False)
            if self.pause and page + 1 < partition.last:
                time.sleep(self.pause)

    def read_on(self) -> Iterator[tuple[int, int, str]]:
        """Page after page, until there is no token or one that was used before; without tokens, until a page is short."""
        page, token = 0, self.token
        used = {token}
        while True:
            body = self.body(page, token)
            items = items_at(body, self.path) if body else []
            for pos, item in enumerate(items):
                yield page, pos, json.dumps(item, ensure_ascii=False)
            if self.next:
                token = _at(json.loads(body), self.next) if body else None
                token = "" if token is None else str(token)
                if not token or token in used:
                    return
                used.add(token)
            elif len(items) < self.size:
                return
            page += 1
            time.sleep(self.pause)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource); spark.read.format("paged").options(url=…, total=…).load()``.

    Options: url with {offset}, {size}, {page} and {token}; total; pageSize; start (of the first offset); items (path of the list);
    pagesPerTask; retries, delay and pause in seconds. Rows are (page, pos, item), the item as JSON text.

    Without total the pages are read in sequence: with next, the path of the continuation token or cursor in each page (first is the
    one of the first page, firstUrl its address if it differs), else up to the first page of fewer than pageSize items. missing tells
    whether a page answered by 404 fails (the default without total) or counts as empty (with total).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})
