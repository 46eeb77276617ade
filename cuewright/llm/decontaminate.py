"""Benchmark decontamination.

Item-sized windows of a document are SimHashed over their word shingles. A multi-index looks them up: the fingerprint's bits
make ``BLOCKS`` blocks, every item is filed under all values within ``NEAR`` bits of its own in each block, and of two fingerprints
within the radius some block lies that near (pigeonhole). Exact weighted-shingle similarity decides about the items found. Windows
of which too few shingles occur anywhere in the benchmark to reach the similarity with any item aren't fingerprinted.
Documents are only scanned, never shuffled; a benchmark over ``PART_BYTES`` goes to the tasks in parts, one after the other.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import materialise

WORDS, SIMILARITY = 5, 0.8
#: Blocks of the 64 bits and the bits by which a block may differ. Fingerprints that differ in up to ``RADIUS`` bits share such a
#: block. Texts of similarity 0.8 differ in about 10 bits; the radius is three standard deviations above.
BLOCKS, NEAR = 5, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes of benchmark text in one part, that is in one broadcast.
PART_BYTES = 1 << 20
#: Numbers of rows with leaks that go to every task at most; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Windows looked up at a time.
_PIECE = 4_096
_WORD = re.compile(r"\w+")
_CUTS = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation and white space only separate."""
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], k: int = WORDS) -> list[str]:
    """``k``-word shingles, repeats included; fewer words: the whole sequence; none: none."""
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard similarity of two shingle lists."""
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if both else 0.0


def _bits(shingles: list[str]) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in shingles], np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)


def _pack(set_bits: np.ndarray) -> np.ndarray:
    return np.packbits(set_bits.astype(np.uint8), axis=-1)


def window_prints(shingles: list[str], size: int) -> np.ndarray:
    """Fingerprints (rows of 8 bytes) of all windows of ``size`` consecutive shingles, by sliding bit counts."""
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(shingles), axis=0)))
    size = min(size, len(shingles))
    return _pack((total[size:] - total[:-size]) * 2 > size)


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    """Block ``k`` of fingerprints (rows of 8 bytes)."""
    lo, hi = _CUTS[k], _CUTS[k + 1]
    return ((np.ascontiguousarray(prints).view(np.uint64).ravel() >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)


class Index:
    """Benchmark items by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], least: float = SIMILARITY):
        self.least, self.vocabulary = least, {}
        self.items: list[tuple[int, int, list[str]]] = []  # identifier, words in a shingle, shingles
        known: dict[int, set] = {}
        prints = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles, k = shingles_of(words), min(WORDS, len(words))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            known.setdefault(k, set()).update(tuple(ids[i : i + k]) for i in range(len(shingles)))
            self.items.append((item_id, k, shingles))
            prints.append(window_prints(shingles, len(shingles))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        #: by words in a shingle, the hashes of all shingles there are
        self.known = {k: np.sort(self._mix(np.array(sorted(g), np.int64))) for k, g in known.items()}
        #: (words in a shingle, shingles of an item) that occur, and those of each item
        self.sizes = sorted({(k, len(s)) for _, k, s in self.items})
        self.size_of = np.array([self.sizes.index((k, len(s))) for _, k, s in self.items], np.int64)
        self.files = [self._file(k) for k in range(BLOCKS)]

    def _file(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start of each block value's items, items): an item stands under every value that its own is near."""
        width = _CUTS[k + 1] - _CUTS[k]
        flips = np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(width), n)], np.int64)
        values = (_block(self.prints, k)[:, None] ^ flips).ravel()
        order = np.argsort(values, kind="stable")
        return np.searchsorted(values[order], np.arange((1 << width) + 1)).astype(np.int32), (order // len(flips)).astype(np.int32)

    @staticmethod
    def _mix(ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.uint64)
        for column in ids.T:
            out = (out + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items within the radius of each fingerprint, by looking its blocks up."""
        windows, items = [], []
        for k, (starts, filed) in enumerate(self.files):
            value = _block(prints, k)
            n = starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(prints)), n)
            item = filed[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[value], n)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
            windows.append(window[close]), items.append(item[close])
        both = np.unique(np.concatenate(windows) * len(self.items) + np.concatenate(items))
        return both // len(self.items), both % len(self.items)

    def hits(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item_id, similarity, first word) of each item's most similar window, the earliest of equals."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, int]] = {}
        for k, table in self.known.items():
            n = len(words) - k + 1
            if n <= 0:
                continue
            known = np.convolve(ids >= 0, np.ones(k, int), "valid") == k
            at = np.nonzero(known)[0]
            if not len(at):
                continue
            h = self._mix(ids[at[:, None] + np.arange(k)])
            known[at] = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
            counts = np.concatenate(([0], np.cumsum(known)))
            if not counts[-1]:
                continue
            own = None
            for number, (words_in, size) in enumerate(self.sizes):
                if words_in != k:
                    continue
                window = min(size, n)
                # similarity s of n and m shingles shares s (n + m) / (1 + s) of them
                shared = self.least * (window + size) / (1 + self.least)
                could = np.nonzero(counts[window:] - counts[:-window] >= shared - 1e-9)[0]
                if not len(could):
                    continue
                if own is None:
                    own = shingles_of(words, k)
                self._look(number, own, could, window, best)
        return [(self.items[i][0], *best[i]) for i in sorted(best) if best[i][0] >= self.least]

    def _look(self, number: int, own: list[str], could: np.ndarray, window: int, best: dict[int, tuple[float, int]]) -> None:
        """Look up the windows that start at ``could`` among the items of one size."""
        cuts = np.nonzero(np.diff(could) > window)[0] + 1  # stretches of overlapping windows, and pieces of long ones
        for part in np.split(could, np.union1d(cuts, np.arange(_PIECE, len(could), _PIECE))):
            lo = int(part[0])
            prints = window_prints(own[lo : int(part[-1]) + window], window)[part - lo]
            at, items = self.near(prints)
            right = self.size_of[items] == number
            for w, item in zip(part[at[right]].tolist(), items[right].tolist(), strict=True):
                s = similarity(own[w : w + window], self.items[item][2])
                old = best.get(item, (0.0, 0))
                if s > old[0] or (s == old[0] and w < old[1]):
                    best[item] = (s, w)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text) of the items, and how many parts they make."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    return items, max(1, -(-total // PART_BYTES))


def _index(items: DataFrame, part: int, parts: int, least: float):
    """The broadcast index over one part of the items."""
    own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else items
    rows = sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return items.sparkSession.sparkContext.broadcast(Index(rows, least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``similarity`` of the best item-sized
    window and its ``first_word`` (from 0).

    A document with fewer words than the item is one window. Items of fewer than five words match where they stand
    whole; items without words match nothing. Null and empty texts hold nothing. Repeated rows are reported
    each. Other columns aren't read. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` long, `{item_col}` long, similarity double, first_word long"
    names = [id_col, item_col, "similarity", "first_word"]
    items, parts = _items(benchmark, item_col, item_text_col)
    found = []
    for part in range(parts):
        index = _index(items, part, parts, least)

        def scan(batches, index=index):
            for batch in batches:
                held = [(i, *h) for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True) for h in index.value.hits(t.as_py())]
                columns = list(zip(*held, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=names)

        found.append(rows.mapInArrow(scan, schema))
        if parts > 1:  # a part's index leaves the driver and the tasks before the next one comes
            found[-1] = materialise(found[-1], "leaks-part")
            index.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item, with the input's own columns."""
    items, parts = _items(benchmark, item_col, item_text_col)
    if parts == 1:
        return docs.where(_clean(_index(items, 0, 1, least))(F.col(text_col)))
    # the documents are written once, to have row numbers; each part of the items then gives the numbers of rows that hold one of its items
    landed = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "leaks-landed")
    hits = None
    for part in range(parts):
        index = _index(items, part, parts, least)
        own = landed.where(~_clean(index)(F.col(f"row.`{text_col}`"))).select("rid")
        own = materialise(own if hits is None else own.unionByName(hits), "leaks-rows")
        index.destroy()
        hits = own
    gone = hits.distinct()
    gone = F.broadcast(gone) if hits.count() <= BROADCAST_ROWS else gone
    return landed.join(gone, "rid", "left_anti").select("row.*")


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not index.value.hits(t)).astype(bool)

    return clean
