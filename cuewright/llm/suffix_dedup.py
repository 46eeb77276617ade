"""Repeated-passage removal over whole corpora by suffix grouping.

Every window of ``LENGTH`` bytes has an anchor: the ``GRAM``-byte string of smallest hash in it, the leftmost of equals. Equal windows have
equal anchors at equal offsets, so windows can only repeat inside the rows of one anchor. A run of windows that share an anchor is
one context. Hashes only say which contexts may have a window in common and so must meet; bytes decide. Contexts that are equal as
a whole are one entry with several places (found first in each batch, so a passage that a third of all documents share costs a row per
batch), and a suffix array of an anchor's different entries shows which of their windows are equal.

The suffix array is built by linear grouping construction: suffixes are kept in groups by their Lyndon prefix; groups are processed
from the highest to the lowest, the previous-smaller pointers of a group's members splitting the groups below it; then the
groups' own order is emitted from left to right along the same pointers, without renaming or recursion.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm import tokens
from cuewright.llm.common import materialise, materialise_dealt, scratch, tidy

LENGTH, GRAM = 100, 32
#: Every window holds either the bytes from ``_LEFT`` before its anchor up to its end, or the anchor and ``_RIGHT`` bytes in all.
_LEFT, _RIGHT = 34, 66
_SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time, and bytes of one suffix array (a larger anchor's contexts make one of their own).
CHUNK, JOINED = 2 << 20, 1 << 15
#: An anchor with more different contexts than one task should hold is settled window by window, by the windows' bytes.
MOST_CONTEXTS = 4_096
#: Rows that say where passages are, sent to all tasks up to this many bytes; beyond it, they are dealt to the texts' buckets.
BROADCAST_BYTES, _ROW_BYTES = 16 << 20, 32
_LAST = np.iinfo(np.int64).max


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` in order, by linear grouping construction."""
    n = len(text)
    if n < 2:
        return list(range(n))
    s = [*text, min(text) - 1]  # a last sign below all others
    n += 1
    order = np.argsort(np.array(s), kind="stable").tolist()
    place, group, end = [0] * n, [0] * n, [0] * n  # group: first slot; end: last slot, by first slot
    start = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            start = k
        place[i], group[i], end[start] = k, start, k
    before = [-1] * n

    def split(own: list[int], g: int) -> None:
        """Put ``own`` into a group right above what is left of their group."""
        last = end[g]
        new = last - len(own) + 1
        if new == g:
            return
        slot = last
        for x in own:
            p, y = place[x], order[slot]
            order[p], order[slot] = y, x
            place[y], place[x] = p, slot
            group[x] = new
            slot -= 1
        end[new], end[g] = last, new - 1

    top = n - 1
    while top >= 0:
        g = group[order[top]]
        if g == top:
            i = order[top]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0 and end[group[j]] != group[j]:
                split([j], group[j])
        else:
            count: dict[int, int] = {}
            for i in sorted(order[g : top + 1]):
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    count[j] = count.get(j, 0) + 1
            levels: dict[int, dict[int, list[int]]] = {}
            for j, times in count.items():
                levels.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(levels, reverse=True):
                for h, own in levels[times].items():
                    split(own, h)
        top = g - 1
    out, put = [-1] * n, [False] * n
    free = list(range(n))  # next free slot, by group
    out[0] = n - 1
    put[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = before[j]
    return out[1:]


def equal_windows(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """(context, offset) rows of every window that also starts earlier: in an earlier context or further left."""
    joined = b"".join(c + b"\0" for c in contexts)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(c) for c in contexts])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    context = np.repeat(np.arange(len(contexts)), lengths + 1)
    offset = np.arange(len(data)) - starts[context]
    order = np.array(suffix_array(list(joined)), np.int64)
    order = order[offset[order] + length <= lengths[context[order]]]
    if len(order) < 2:
        return np.empty((0, 2), np.int64)
    if length < 8:
        eights, steps = data, range(length)
    else:  # eight bytes at every position, read in place
        eights = np.ndarray((len(data) - 7,), "<u8", joined, strides=(1,))
        steps = [*range(0, length - 8, 8), length - 8]
    pairs = np.arange(1, len(order))
    for step in steps:  # neighbours in suffix order that are still equal
        pairs = pairs[eights[order[pairs] + step] == eights[order[pairs - 1] + step]]
    same = np.zeros(len(order), bool)
    same[pairs] = True
    run = np.cumsum(~same)
    first = np.full(run[-1] + 1, len(data))
    np.minimum.at(first, run, order)
    again = order[first[run] != order]
    return np.stack((context[again], offset[again]), axis=1)


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = tokens._powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def contexts_of(data: np.ndarray, offsets: np.ndarray):
    """(text, first window, last window, anchor hash, hash of the context, hash of either stretch, middle) arrays.

    Window positions count inside their text. Windows from the middle on hold the right stretch, those up to it the left one; a
    context without such windows has its own hash instead. The hash of the context and those of its stretches have 32 bits.
    """
    n = len(data)
    lengths = np.diff(offsets)
    if n < LENGTH or not (lengths >= LENGTH).any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64, np.int64))
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = _mix(hashes.of(at, at + GRAM), 0xD6E8FEB86659FD93)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # leftmost of equals
    span = 1
    while span * 2 <= _SPAN:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[_SPAN - span :][: n - LENGTH + 1])
    text = np.repeat(np.arange(len(lengths)), lengths)
    window = np.nonzero(text[: n - LENGTH + 1] == text[LENGTH - 1 :])[0]
    anchor = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.nonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))))[0]
    first, last, anchor = window[cut], window[np.concatenate((cut[1:] - 1, [len(window) - 1]))], anchor[cut]
    key = grams[anchor]
    body = _mix(hashes.of(first, last + LENGTH) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xA24BAED4963EE407)
    body += (last - first).astype(np.uint64)
    own, middle = text[first], anchor - _LEFT
    left = np.where(first <= middle, _mix(hashes.of(np.maximum(middle, 0), anchor + GRAM), 0x9FB21C651E98DF25), body)
    right = np.where(last >= middle, _mix(hashes.of(anchor, np.minimum(anchor + _RIGHT, n)), 0x9FB21C651E98DF25), body)
    body, left, right = (x >> np.uint64(32) for x in (body, left, right))
    return own, first - offsets[own], last - offsets[own], key, body, left, right, middle - offsets[own]


def _equal_to_first(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: tuple, order: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whether each is byte for byte the first row of its keys, and not that row itself)."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    if not len(by):
        return by, np.empty(0, bool)
    again = np.concatenate(([False], np.logical_and.reduce([k[by][1:] == k[by][:-1] for k in keys])))
    first = by[np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))]
    at = np.nonzero(again)[0]
    a, b, n = start[by[at]], start[first[at]], (end - start)[by[at]]
    same = n == (end - start)[first[at]]
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))  # eight bytes at every position, read in place
    for step in range(0, int(n.max(initial=0)), 8):
        k = np.minimum(step, n - 8)
        same[same] = eights[(a + k)[same]] == eights[(b + k)[same]]
    again[at] = same
    return by, again


_OCC = "anchor long, body int, left int, right int, doc long, rid long, first int, last int, middle int"


def _batch(doc, rid, first, last, middle=None, **hashes) -> pa.RecordBatch:
    """Rows of ``_OCC``; hashes that aren't given are null."""
    n = len(rid)
    arrays = [pa.array(hashes["anchor"].view(np.int64)) if "anchor" in hashes else pa.nulls(n, pa.int64())]
    arrays += [pa.array(hashes[k].astype(np.uint32).view(np.int32)) if k in hashes else pa.nulls(n, pa.int32()) for k in ("body", "left", "right")]
    arrays += [pa.array(doc), pa.array(rid), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
    arrays.append(pa.nulls(n, pa.int32()) if middle is None else pa.array(middle.astype(np.int32)))
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "body", "left", "right", "doc", "rid", "first", "last", "middle"])


def _merged(rid: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Byte intervals [lo, hi) united per row."""
    by = np.lexsort((lo, rid))
    rid, doc, lo, hi = rid[by], doc[by], lo[by].astype(np.int64), hi[by].astype(np.int64)
    if not len(rid):
        return rid, doc, lo, hi
    change = np.concatenate(([True], rid[1:] != rid[:-1]))
    base = np.cumsum(change) * np.int64(1 << 33)
    reach = np.maximum.accumulate(hi + base)
    new = change | np.concatenate(([True], (lo + base)[1:] > reach[:-1]))
    at = np.nonzero(new)[0]
    return rid[at], doc[at], lo[at], (reach - base)[np.concatenate((at[1:] - 1, [len(rid) - 1]))]


def _find(batches):
    """Contexts of all texts. Rows without anchor are bytes to remove: contexts that the batch holds earlier, byte for byte."""
    for batch in batches:
        docs, rids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("rid").to_numpy()
        data, offsets = tokens.column_bytes(batch.column("text"))
        held: list[tuple] = []
        for at, part in tokens.batches_of(batch.column("text"), CHUNK):
            text, first, last, key, body, left, right, middle = contexts_of(*tokens.column_bytes(part))
            held.append((key, body, left, right, middle, at + text, first, last))
        key, body, left, right, middle, text, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
        doc, rid, start = docs[text], rids[text], offsets[text]
        by, again = _equal_to_first(data, start + first, start + last + LENGTH, (key, body), (doc, rid, first))
        gone, kept = by[again], by[~again]
        yield _batch(doc[kept], rid[kept], first[kept], last[kept], middle[kept], anchor=key[kept], body=body[kept], left=left[kept], right=right[kept])
        r, d, lo, hi = _merged(rid[gone], doc[gone], first[gone], last[gone] + LENGTH)
        yield _batch(d, r, lo, hi)


def _settle(batches):
    """All rows of the partition's anchors: those that may share a window with another row stay, cut to the windows in question. Of
    anchors with very many different ones, ``body`` is set. Bytes to remove (no anchor) pass."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    ready = t.filter(pa.compute.is_null(t["anchor"]))
    for b in ready.combine_chunks().to_batches():
        yield b
    t = t.filter(pa.compute.is_valid(t["anchor"]))
    key = t["anchor"].to_numpy().view(np.uint64)
    body, left, right, doc, rid, first, last, middle = (t[c].to_numpy().astype(np.int64) for c in ("body", "left", "right", "doc", "rid", "first", "last", "middle"))
    equal, lefts, rights = _shared(key, body), _shared(key, left), _shared(key, right)
    own = equal | lefts | rights  # others have no window in common with another context
    first, last = np.where(lefts | equal, first, np.maximum(first, middle)), np.where(rights | equal, last, np.minimum(last, middle))
    crowded = np.zeros(len(key), bool)
    if own.any():
        kinds = np.unique(np.stack((key[own].view(np.int64), body[own]), axis=1), axis=0)[:, 0]
        anchors, many = np.unique(kinds, return_counts=True)
        crowded[own] = np.isin(key[own].view(np.int64), anchors[many > MOST_CONTEXTS])
    k = np.nonzero(own & ~crowded)[0]
    yield _batch(doc[k], rid[k], first[k], last[k], anchor=key[k])
    k = np.nonzero(crowded)[0]
    yield _batch(doc[k], rid[k], first[k], last[k], anchor=key[k], body=body[k])


def _shared(key: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Whether another row has the same key and stretch."""
    by = np.lexsort((stretch, key))
    same = (key[by][1:] == key[by][:-1]) & (stretch[by][1:] == stretch[by][:-1]) if len(by) else np.empty(0, bool)
    out = np.zeros(len(key), bool)
    out[by[1:]] |= same
    out[by[:-1]] |= same
    return out


def _contexts(batches):
    """The bytes of the contexts that ``spots`` lists for each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc, rid, spots, text in zip(*(batch.column(c) for c in ("doc", "rid", "spots", "text")), strict=True):
            data = text.as_py()
            for spot in spots.as_py():
                for column, value in zip(out, (spot["anchor"], doc.as_py(), rid.as_py(), spot["first"], data[spot["first"] : spot["last"] + LENGTH]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "doc", "rid", "first", "bytes"])


def _compare(batches):
    """Contexts sorted by anchor and then document: bytes to remove. Equal contexts are one entry, at the first one's place; the suffix
    array is over the entries of whole anchors."""

    def solve(rows):
        entries: dict[bytes, tuple] = {}
        rid, doc, lo, hi = [], [], [], []
        for row in rows:
            if entries.setdefault(row[4], row) is not row:
                rid.append(row[2]), doc.append(row[1]), lo.append(row[3]), hi.append(row[3] + len(row[4]))
        kinds: dict[int, int] = {}
        for row in entries.values():
            kinds[row[0]] = kinds.get(row[0], 0) + 1
        own = [row for row in entries.values() if kinds[row[0]] > 1]  # an entry alone repeats no window
        hits = equal_windows([row[4] for row in own]) if own else np.empty((0, 2), np.int64)
        r, d, first = (np.array([row[k] for row in own], np.int64) for k in (2, 1, 3))
        more = first[hits[:, 0]] + hits[:, 1]
        all_of = lambda found, own: np.concatenate((np.array(found, np.int64), own))
        r, d, lo, hi = _merged(all_of(rid, r[hits[:, 0]]), all_of(doc, d[hits[:, 0]]), all_of(lo, more), all_of(hi, more + LENGTH))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(lo), pa.array(hi)], names=["rid", "lo", "hi"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "rid", "first", "bytes")), strict=True):
            if size >= JOINED and held[-1][0] != row[0]:
                yield from solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield from solve(held)


def _windows(batches):
    """The windows of the listed contexts with their bytes; without bytes, those that the batch holds earlier."""
    for batch in batches:
        found = set()
        for doc, rid, spots in zip(*(batch.column(c).to_pylist() for c in ("doc", "rid", "spots")), strict=True):
            found.update((doc, rid, at) for s in spots for at in range(s["first"], s["last"] + 1))
        texts = dict(zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True))
        rows, seen, held, data = [], set(), None, b""
        for doc, rid, at in sorted(found):
            if rid != held:
                held, data = rid, texts[rid].as_py()
            window = data[at : at + LENGTH]
            rows.append((None if window in seen else window, doc, rid, at))
            seen.add(window)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["bytes", "doc", "rid", "lo"])


def _beside(rows: DataFrame, gathered: Column, count: int, parts: int, texts: DataFrame, how: str = "inner") -> DataFrame:
    """``texts``, dealt by rid to ``parts`` buckets, joined to the ``count`` places of ``rows``, gathered per rid. Texts aren't shuffled."""
    if count * _ROW_BYTES <= BROADCAST_BYTES:
        return texts.join(F.broadcast(rows.groupBy("rid").agg(gathered)), "rid", how)
    return texts.join(rows.repartition(parts, "rid").groupBy("rid").agg(gathered).hint("shuffle_hash"), "rid", how)


def _with_text(rows: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """``rows`` (anchor, doc, rid, first, last) gathered per text, with the text's bytes."""
    spots = F.collect_list(F.struct("anchor", "first", "last")).alias("spots")
    return _beside(rows, spots, rows.count(), parts, texts).select("doc", "rid", "spots", "text")


def repeated_bytes(texts: DataFrame, parts: int) -> DataFrame:
    """(rid, lo, hi) byte intervals to remove from ``texts`` (doc long never null, rid long unique, text binary), dealt by rid to ``parts``
    buckets."""
    found = texts.mapInArrow(_find, _OCC).repartition(F.coalesce("anchor", "rid"))
    settled = materialise(found.mapInArrow(_settle, _OCC), "suffix-settled")
    del found
    tidy(texts.sparkSession)
    done = settled.where("anchor is null").select("rid", F.col("first").cast("long").alias("lo"), F.col("last").cast("long").alias("hi"))
    bytes_ = _with_text(settled.where("anchor is not null and body is null"), texts, parts).mapInArrow(_contexts, "anchor long, doc long, rid long, first int, bytes binary")
    compared = bytes_.repartition("anchor").sortWithinPartitions("anchor", "doc", "rid", "first").mapInArrow(_compare, "rid long, lo long, hi long")
    out = done.unionByName(compared)
    crowded = settled.where("anchor is not null and body is not null")
    if not crowded.isEmpty():
        windows = materialise(_with_text(crowded, texts, parts).mapInArrow(_windows, "bytes binary, doc long, rid long, lo long"), "suffix-windows")
        later = windows.where("bytes is not null").withColumn("nth", F.row_number().over(Window.partitionBy("bytes").orderBy("doc", "rid", "lo"))).where("nth > 1")
        out = out.unionByName(later.select("rid", "lo", (F.col("lo") + LENGTH).alias("hi"))).unionByName(windows.where("bytes is null").select("rid", "lo", (F.col("lo") + LENGTH).alias("hi")))
    return out


def _report(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, kept, at, removed, runs = text.as_py(), hashlib.sha256(), 0, 0, 0
            end = -1
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans.as_py() or ()):
                if lo > end:
                    kept.update(data[at:lo])
                    runs += 1
                    removed += hi - lo
                elif hi > end:
                    removed += hi - end
                at = end = max(end, hi)
            kept.update(data[at:])
            n_bytes.append(len(data)), n_removed.append(removed), n_spans.append(runs), digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)], pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(landed id, doc, rid, text in buckets by rid; intervals to remove; number of buckets)."""
    parts = max(1, docs.rdd.getNumPartitions())
    with scratch(docs.sparkSession):
        landed = materialise_dealt(
            docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("doc"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")),
            "suffix-texts", "rid", parts, keep=True,
        )
        intervals = materialise(repeated_bytes(landed.select("doc", "rid", "text"), parts), "suffix-intervals", keep=True)
    return landed, intervals, parts


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of what stays.

    A byte goes if a window of ``LENGTH`` bytes that covers it also starts earlier: in a row of smaller identifier (null
    identifiers last; rows that repeat one in the order of the table) or further left in the same text. Null texts are empty;
    shorter texts keep everything. Other columns aren't read. An empty table gives no rows.
    """
    landed, intervals, parts = _prepared(docs, id_col, text_col)
    spans = F.collect_list(F.struct("lo", "hi")).alias("spans")
    rows = _beside(intervals, spans, intervals.count(), parts, landed, "left").select("id", "text", "spans")
    return rows.mapInArrow(_report, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
