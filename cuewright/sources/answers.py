"""Recorded search answers as a data source (inventory A5-A8, A13b, A15, Q10): ``spark.read`` or ``spark.readStream`` of ``recorded_answers``.

A folder holds an answer a page, ``query=<text>/index=<first place>/<any files>``, as Spark writes it partitioned by these two; each is a JSON object
with a list ``data``. So that pages needn't be a file each, a folder ``block=<n>`` beside them may hold the pages of ``BLOCK`` places in a row, an object a
line that says its ``index``. A partition is a query: what a page is asked for depends on what the ones before it gave, so a query's pages are read one
after the other, and only as far as its limit or its first empty page. Filters on ``query`` leave other queries' partitions out.

As a stream, queries are taken by name, at most ``requests`` a trigger, so the trigger's interval sets the pace that the answering side is promised. The
offset is the last name taken: a stopped stream goes on behind it, and each answer comes once. New queries' names must sort behind those before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

FORMAT = "recorded_answers"
SCHEMA = "query string, index int, pos int, id long, title string, artist string, album string, preview string"
#: Items that a page holds at most, and that a query gives at most unless option ``limit`` says otherwise.
PAGE, LIMIT = 25, 25
#: Pages of a block; the place of its first is its number times these times the page's size.
BLOCK = 64


@dataclass
class QueryPages(InputPartition):
    query: str
    folder: str


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.page = options["path"], int(options.get("limit", LIMIT)), int(options.get("page", PAGE))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("query",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each recorded query that the filters leave, by name; listing them reads no answers."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = {}
        if self.wanted is not None:  # no listing of all queries for a few
            folders = [f"{root}/query={quote(q, safe=' ')}" for q in self.wanted] + [f"{root}/query={q}" for q in self.wanted]
            infos = files.get_file_info(folders)
        else:
            infos = files.get_file_info(fs.FileSelector(root))
        for info in infos:
            name = info.base_name
            if info.type == fs.FileType.Directory and name.startswith("query="):
                found[unquote(name[6:])] = info.path
        return [QueryPages(q, folder) for q, folder in sorted(found.items()) if self.wanted is None or q in self.wanted]

    def read(self, partition: QueryPages | None) -> Iterator[tuple]:
        if partition is None:  # no partition was planned
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        fetched = index = 0
        block: tuple[int, dict[int, list]] = (-1, {})
        while fetched < self.limit:
            size = min(self.page, self.limit - fetched)
            items = self._items(files, f"{partition.folder}/index={index}")
            if not items:
                if (number := index // (self.page * BLOCK)) != block[0]:
                    block = number, self._block(files, f"{partition.folder}/block={number}")
                items = block[1].get(index)
            if not items:
                return
            for pos, item in enumerate(items[:size]):
                artist, album = item.get("artist") or {}, item.get("album") or {}
                yield partition.query, index, pos, item.get("id"), item.get("title") or "", artist.get("name") or "", album.get("title") or "", item.get("preview")
            fetched += min(size, len(items))
            index += self.page

    @staticmethod
    def _contents(files: fs.FileSystem, folder: str) -> Iterator[bytes]:
        for info in sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                with files.open_input_stream(info.path) as f:
                    yield f.read()

    @classmethod
    def _items(cls, files: fs.FileSystem, folder: str) -> list[dict]:
        """A page's items; none if it wasn't recorded. A damaged answer is an error."""
        return [item for text in cls._contents(files, folder) for item in json.loads(text).get("data") or []]

    @classmethod
    def _block(cls, files: fs.FileSystem, folder: str) -> dict[int, list[dict]]:
        """The items of a block's pages by index."""
        pages = [json.loads(line) for text in cls._contents(files, folder) for line in text.splitlines() if line.strip()]
        out: dict[int, list[dict]] = {}
        for page in pages:
            out.setdefault(page["index"], []).extend(page.get("data") or [])
        return out


class PacedReader(DataSourceStreamReader):
    """The plan of a trigger is kept at ``progress``: Spark doesn't say where a restarted stream stands when it asks how far to go."""

    def __init__(self, options: dict):
        self.answers = AnswerReader(options)
        self.requests, self.progress = int(options.get("requests", 1)), options["progress"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.progress)
        after = ""
        if files.get_file_info(f"{root}/planned.json").type == fs.FileType.File:
            with files.open_input_stream(f"{root}/planned.json") as f:
                after = json.loads(f.read())["after"]
        waiting = [p.query for p in self.answers.partitions() if p.query > after][: self.requests]
        return {"after": waiting[-1] if waiting else after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.progress)
        files.create_dir(root)
        with files.open_output_stream(f"{root}/planned.json") as f:
            f.write(json.dumps(end).encode())
        return [p for p in self.answers.partitions() if start["after"] < p.query <= end["after"]]

    def read(self, partition: QueryPages) -> Iterator[tuple]:
        return self.answers.read(partition)


class AnswerSource(DataSource):
    """Options: ``path`` (a URI or an absolute path), ``limit`` items a query, ``page`` items a page; of a stream ``requests`` a trigger and
    ``progress``, a folder of its own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(self.options)

    def streamReader(self, schema) -> PacedReader:
        return PacedReader(self.options)


def register(spark: SparkSession) -> None:
    """Let ``spark`` read the format, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswerSource)
