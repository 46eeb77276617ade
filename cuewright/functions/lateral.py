"""Parsers that SQL calls in a lateral join (inventory E1-E3, D-1 to D-3): ``SELECT d.id, e.* FROM d, LATERAL list_entries(d.text, 'timed') e``.

One table function, whose columns depend on the kind of list, a constant. The DataFrame forms in ``extract`` stay the way for large tables, as they
run in the JVM; these give the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cuewright.functions.extract import GENERIC_CHAPTER, LEAST_UNTIMED, LIST_KEYWORD, TIMED_LINE, TRACK_NUMBER, UNTIMED_LINE
from cuewright.functions.text import SEPARATORS

KINDS = ("timed", "untimed", "chapters")
#: White space of any kind, as the column functions strip it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_PAIR = re.compile(r"^(?:\[(.*)\]|\((.*)\))$", re.S)
_TIMED, _UNTIMED, _KEYWORD, _GENERIC, _NUMBER = (re.compile(p, re.A) for p in (TIMED_LINE, UNTIMED_LINE, LIST_KEYWORD, GENERIC_CHAPTER, TRACK_NUMBER))


def _unwrapped(x: str) -> str:
    x = x.strip(_WHITE)
    m = _PAIR.match(x)
    return (m[1] or m[2] or "").strip(_WHITE) if m else x


def _names(rest: str) -> tuple[str, str]:
    for sep in SEPARATORS:
        if sep in rest:
            artist, title = rest.split(sep, 1)
            return _unwrapped(artist), _unwrapped(title)
    return "", _unwrapped(rest)


class ListEntries:
    """(pos, start_sec unless untimed, artist, title) of a list of the kind in a text; null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"the kind of list must be one of {', '.join(KINDS)}")
        schema = StructType().add("pos", IntegerType())
        if kind.value != "untimed":
            schema = schema.add("start_sec", DoubleType())
        return AnalyzeResult(schema.add("artist", StringType()).add("title", StringType()))

    def eval(self, text: str | None, kind: str) -> Iterator[tuple]:
        if text is not None:
            yield from {"timed": self._timed, "untimed": self._untimed, "chapters": self._chapters}[kind](text)

    @staticmethod
    def _timed(text: str) -> Iterator[tuple]:
        for pos, line in enumerate(text.splitlines()):
            if m := _TIMED.search(line):
                artist, title = _names(m[2])
                seconds = 0.0
                for part in m[1].split(":"):
                    seconds = seconds * 60 + int(part)
                if title:
                    yield pos, seconds, artist, title

    @staticmethod
    def _untimed(text: str) -> Iterator[tuple]:
        if not _KEYWORD.search(text):
            return
        found = [(pos, *_names(m[1])) for pos, line in enumerate(text.splitlines()) if not _TIMED.search(line) and (m := _UNTIMED.search(line))]
        found = [row for row in found if row[2]]
        if len(found) >= LEAST_UNTIMED:
            yield from found

    @staticmethod
    def _chapters(text: str) -> Iterator[tuple]:
        try:
            marks = json.loads(text).get("chapters") or []
        except (ValueError, AttributeError):
            return
        for pos, mark in enumerate(marks):
            name = (mark.get("title") or "").strip(_WHITE)
            if mark.get("start_time") is None or not name or _GENERIC.search(name):
                continue
            artist, title = _names(_NUMBER.sub("", name, count=1))
            if title:
                yield pos, float(mark["start_time"]), artist, title


def register(spark: SparkSession) -> None:
    """Let SQL call ``list_entries(text, kind)``."""
    spark.udtf.register("list_entries", udtf(ListEntries))
