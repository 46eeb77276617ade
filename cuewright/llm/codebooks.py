"""Product codes of vectors: a codebook for each of 16 equal parts, learnt by whole-number rounds of assigning and averaging.

A part is assigned by Exponion search: from its entry of the round before, at squared distance u, only entries whose squared distance
from that one is at most 4u can be as near (triangle inequality), and those lead the entry's list of neighbours by distance. All distances are
whole numbers and compared exactly; ties go to the lower index. Codebooks are of fixed size (16 parts, 64 entries), so they travel in the
tasks' closures; vectors are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import join_hot, materialise, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances that one step of a search holds.
PAIRS = 1 << 20
#: Squared distances stay below this, so that distance and index fit one number.
MOST = 1 << 57


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, squared distances) of all entries from each entry, by distance, then index."""
    far = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, 1)


def exponion(points: np.ndarray, entries: np.ndarray, start: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of every point, ties to the lower index, searched from entry ``start``."""
    order, far = lists
    own = ((points - entries[start]) ** 2).sum(1)
    reach = np.empty(len(points), np.int64)  # neighbours inside the radius, the entry itself included
    by = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by], np.arange(len(entries) + 1))
    for a in range(len(entries)):
        rows = by[cuts[a] : cuts[a + 1]]
        reach[rows] = np.searchsorted(far[a], 4 * own[rows], "right")
    ends = np.cumsum(reach)
    best = np.empty(len(points), np.int64)
    at = 0
    while at < len(points):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = reach[at:to]
        firsts = np.cumsum(n) - n
        rows = np.repeat(np.arange(at, to), n)
        tried = order[start[rows], np.arange(len(rows)) - np.repeat(firsts, n)]
        best[at:to] = np.minimum.reduceat(((points[rows] - entries[tried]) ** 2).sum(1) * ENTRIES + tried, firsts)
        at = to
    return best % ENTRIES, best // ENTRIES


def _assign(points: np.ndarray, books: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, summed squared distances) of points (n, parts, width) given the codes of the round before."""
    codes, error = np.empty(start.shape, np.uint8), np.zeros(len(points), np.int64)
    for p in range(len(books)):
        code, far = exponion(points[:, p], books[p], start[:, p].astype(np.int64), neighbour_lists(books[p]))
        codes[:, p] = code
        error += far
    return codes, error


def _points(column: pa.Array, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return flat.reshape(len(column), PARTS, width).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    size = rows[0].nbytes if len(rows) else 0
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, label as text, v: 32-bit components) of vectors without null or non-finite components, and the width of a part."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit("")).alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    kept = rows.where(v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest, largest = kept.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = -(-(longest or 0) // PARTS)
    if largest is not None and 4 * width * (int(largest * SCALE) + 1) ** 2 >= MOST:
        raise ValueError(f"components up to {largest} are too large for exact 64-bit distances")

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(lists), PARTS * width), np.int32)
            out[np.arange(PARTS * width)[None, :] < lengths[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _binary(out)], names=["id", "label", "v"])

    return kept.mapInArrow(run, "id long, label string, v binary"), width


def first_entries(rows: DataFrame, width: int) -> np.ndarray:
    """(part, entry, width): the parts of the vectors of the smallest identifiers."""

    def smallest(batches):
        held: dict = {}
        for batch in batches:
            for key, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if key not in held or v < held[key]:
                    held[key] = v
            if len(held) > 4 * ENTRIES:
                held = {k: held[k] for k in sorted(held, key=lambda k: (k is None, k or 0))[:ENTRIES]}
        keys = sorted(held, key=lambda k: (k is None, k or 0))[:ENTRIES]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held[k] for k in keys], pa.binary())], names=["id", "v"])

    found = rows.select("id", "v").mapInArrow(smallest, "id long, v binary").groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()
    flat = np.frombuffer(b"".join(bytes(r["v"]) for r in found), np.int32)
    return flat.reshape(len(found), PARTS, width).astype(np.int64).transpose(1, 0, 2)


def _averages(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are their parts' floored means; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches):
        cells = np.zeros((parts, entries, width + 1), np.int64)  # a part's components, then its count
        for batch in batches:
            points = _points(batch.column("v"), width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(cells[p, :, width], codes[:, p], 1)
                np.add.at(cells[p, :, :width], codes[:, p], points[:, p])
        used = np.nonzero(cells.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells.ravel()[used])], names=["cell", "x"])

    total = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, x in coded.select("v", "codes").mapInArrow(sums, "cell long, x long").groupBy("cell").agg(F.sum("x")).collect():  # as many as the codebooks have numbers
        total[cell] = x
    cells = total.reshape(parts, entries, width + 1)
    n = cells[:, :, width:]
    return np.where(n > 0, cells[:, :, :width] // np.maximum(n, 1), books)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes: 16 bytes, error) per kept row, final codebooks (part, entry, component)).

    Vectors that are null or have null or non-finite components are left out. Shorter vectors count as padded by zeros to the longest, and
    that to a multiple of 16. The first entries are the parts of the 64 smallest identifiers, each once (of repeated ones the vector
    whose bytes are smallest; null identifiers last), so fewer rows give fewer entries. ``label`` is the label as text after ``=``, empty for null.
    Repeated rows stay; an empty table gives no rows and no entries. Components too large for exact 64-bit distances (beyond some
    2^16 at four components a part) are an error. The codes' table stays in the shared folder.
    """
    with scratch(vectors.sparkSession):
        rows, width = whole_numbers(vectors, id_col, vector_col, label_col)
        rows = materialise(rows, "code-parts")
        books = first_entries(rows, width)
        coded = rows.withColumn("codes", F.lit(bytes(PARTS)))  # the first search starts at entry 0
        for step in range(ROUNDS + 1):

            def assign(batches, books=books):
                for batch in batches:
                    start = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
                    codes, error = _assign(_points(batch.column("v"), width), books, start)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), _binary(codes), pa.array(error)], names=["id", "label", "v", "codes", "error"])

            found = coded.select("id", "label", "v", "codes").mapInArrow(assign, "id long, label string, v binary, codes binary, error long")
            if step == ROUNDS:
                return materialise(found.drop("v"), "codes", keep=True), books
            coded = materialise(found, "code-round")
            books = _averages(coded, books)


def code_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes in hex, and the error summed over rows of equal label."""
    coded, books = compress(vectors, id_col, vector_col, label_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "code-labels")
    found = join_hot(coded, by_label, "label", "rows", coded.count())
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
