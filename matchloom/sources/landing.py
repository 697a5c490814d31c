"""Landed pages of list requests as a Spark data source, for batches and streams; nothing here calls a network.

A collector writes the n-th page of a request's answer to `<path>/<request>/page-<n>.json`, an object
whose `result` is a list. Of a request, pages are taken from the first on until `count` rows are there,
`budget` pages are read, a page is missing, or a page holds fewer rows than were asked of it: a page is
asked for the rows that are still wanted, `page_size` at most. A page that can't be read is an empty one.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("path", folder).option("count", 250).load()

Rows: request, page, pos, row (the object as JSON). A batch has a task for each request. A stream's
offset tells of each request how many pages and rows are taken and whether it is at its end; a trigger
takes `pages_per_trigger` new pages at most, so that what the driver looks at is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "request string, page int, pos int, row string"


@dataclass(frozen=True)
class Rules:
    """Where the pages are and when a request's are enough."""

    path: str
    count: int
    page_size: int
    budget: int
    per_trigger: int

    @staticmethod
    def of(options) -> Rules:
        return Rules(options["path"], int(options.get("count", 1 << 62)), int(options.get("page_size", 100)), int(options.get("budget", 1 << 62)), int(options.get("pages_per_trigger", 1000)))

    def requests(self) -> list[str]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(self.path)
        return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.Directory)

    def page(self, request: str, number: int) -> list | None:
        """The rows of a page; None where there is none yet."""
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(self.path)
        name = f"{top.rstrip('/')}/{request}/page-{number}.json"
        if files.get_file_info(name).type != fs.FileType.File:
            return None
        with files.open_input_stream(name) as file:
            try:
                told = json.loads(file.read())
            except ValueError:
                return []
        found = told.get("result") if isinstance(told, dict) else None
        return found if isinstance(found, list) else []

    def walk(self, request: str, pages: int = 0, rows: int = 0) -> Iterator[tuple[int, list, bool]]:
        """(number, rows, whether it is the last) of the pages behind the first `pages`, which gave `rows` rows."""
        while rows < self.count and pages < self.budget:
            asked = min(self.page_size, self.count - rows)
            found = self.page(request, pages + 1)
            if found is None:
                return
            pages, rows = pages + 1, rows + min(len(found), asked)
            last = len(found) < asked or rows >= self.count or pages >= self.budget
            yield pages, found[:asked], last
            if last:
                return


def rows_of_page(request: str, number: int, found: list) -> Iterator[tuple]:
    for pos, row in enumerate(found):
        yield request, number, pos, json.dumps(row, ensure_ascii=False)


class Request(InputPartition):
    """Pages of one request behind those that are taken, up to a number of them (None: all)."""

    def __init__(self, request: str, pages: int = 0, rows: int = 0, until: int | None = None):
        super().__init__(request)
        self.request, self.pages, self.rows, self.until = request, pages, rows, until


def read_request(rules: Rules, part: Request | None) -> Iterator[tuple]:
    if part is None:  # Spark's way to read a table without partitions
        return
    for number, found, _ in rules.walk(part.request, part.pages, part.rows):
        if part.until is not None and number > part.until:
            return
        yield from rows_of_page(part.request, number, found)


class BatchPages(DataSourceReader):
    def __init__(self, rules: Rules):
        self.rules = rules

    def partitions(self) -> list[Request]:
        return [Request(r) for r in self.rules.requests()]

    def read(self, partition: Request) -> Iterator[tuple]:
        return read_request(self.rules, partition)


class StreamPages(DataSourceStreamReader):
    """Offsets: {request: [pages, rows, done]}."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.rules.per_trigger
        for request in self.rules.requests():
            pages, rows, done = self.seen.get(request, [0, 0, 0])
            if not done:
                for number, found, last in self.rules.walk(request, pages, rows):
                    if not left:
                        break
                    left -= 1
                    pages, rows, done = number, rows + len(found), int(last)
                if pages:
                    self.seen[request] = [pages, rows, done]
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Request]:
        # After a restart the offsets that were planned before are the state to go on from.
        for request, told in end.items():
            if told[0] > self.seen.get(request, [0])[0]:
                self.seen[request] = list(told)
        return [Request(r, *start.get(r, [0, 0, 0])[:2], until=told[0]) for r, told in sorted(end.items()) if told[0] > start.get(r, [0])[0]]

    def read(self, partition: Request) -> Iterator[tuple]:
        return read_request(self.rules, partition)


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchPages:
        return BatchPages(Rules.of(self.options))

    def streamReader(self, schema) -> StreamPages:
        return StreamPages(Rules.of(self.options))
