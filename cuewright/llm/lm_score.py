"""Language-model scores: an exact add-one unigram base, and a causal self-attention model over subword ids.

Words are counted over all training documents; the commonest counts go to every task, the others meet the documents'
rare words in a join. The model reads subword ids of a public tokenizer. By masked self-attention it predicts the next subword's
group, then its class in that group (the commonest subwords are classes of their own); counts give the subword in its class. It starts
from the counts of neighbouring classes in all training documents, and attention learns what these leave. Every training window
is learnt from once: in each round every task takes Adam steps on its share of the round's windows, and the tasks'
parameters are averaged. Texts are scored in windows that overlap: each subword once, in the window where it has more context.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm import tokens
from cuewright.llm.common import crc_mod, materialise, sum_in_levels

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Groups of classes, classes in a group, and classes that hold many rare subwords instead of one.
GROUPS, MEMBERS, BINS = 32, 32, 32
CLASSES = GROUPS * MEMBERS
#: Width of a class, of queries and keys, and of states; window and the part of it that is only context.
D, KEY, STATE, WINDOW, CONTEXT = 16, 8, 16, 32, 8
#: Each window is trained on in one of so many rounds. A task takes at least ``STEPS`` steps of ``FEW`` windows in a round, if need be by
#: going over a small share again; larger shares take batches of up to ``BATCH`` windows, then more steps.
ROUNDS, BATCH, FEW, STEPS = 2, 128, 32, 2500
#: Occurrences of a class that the next one's own frequency weighs as much as.
SMOOTH = 30.0
#: Counts sent to every task; a text's other words are looked up by a join.
COMMON_WORDS = 262_144
_BLOCK = 4096
_CHUNK = 4 << 20
#: Longest word coded whole; words whose ids a task remembers.
_LONG, _KNOWN = 200, 400_000


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=r" [^ ]*|[^ ]+", mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """Subword ids of words, each with a blank before it; the id after the last is the end of a text."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.end = self.encoding.n_vocab
        self.size = self.end + 1
        self.starts = np.array([self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.end)] + [True])
        # words met before: sorted hashes, and the place of each word's ids
        self.keys, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word). One call codes all words: the id that starts with a blank starts a word. Very long words are
        coded in pieces on their own."""
        if any(len(w) > _LONG for w in words):
            lists = []
            for w in words:
                text = " " + w.decode()
                lists.append([i for k in range(0, len(text), _LONG) for i in self.encoding.encode_ordinary(text[k : k + _LONG])])
            return np.array([i for own in lists for i in own], np.int32), np.array(list(map(len, lists)))
        flat = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode()), np.int32)
        return flat, np.diff(np.concatenate((np.nonzero(self.starts[flat])[0], [len(flat)])))

    def of(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, place, number) of the ids of distinct words given by hash and by their bytes low[start:end]."""
        slot = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[slot] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        at, n = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        at[known], n[known] = self.at[slot[known]], self.n[slot[known]]
        flat = self.flat
        new = np.nonzero(~known)[0]
        if len(new):
            data = low.tobytes()
            long = ends[new] - starts[new] > _LONG
            for part in (new[~long], new[long]):
                if len(part):
                    ids, n[part] = self._encode([data[x:y] for x, y in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
                    at[part] = len(flat) + np.cumsum(n[part]) - n[part]
                    flat = np.concatenate((flat, ids))
            if len(self.keys) < _KNOWN:
                order = np.argsort(keys := np.concatenate((self.keys, hashes[new])))
                self.keys, self.at, self.n, self.flat = keys[order], np.concatenate((self.at, at[new]))[order], np.concatenate((self.n, n[new]))[order], flat
        return flat, at, n


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, word starts, word ends, word hashes, word offsets per text)."""
    starts, ends = tokens.space_tokens(data, offsets)
    low = tokens.lower(data)
    return low, starts, ends, tokens.run_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def sequences(low, starts, ends, hashes, cuts, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids of all texts with an end after each, offsets per text)."""
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    flat, place, n = subwords.of(unique, low, starts[first], ends[first])
    own = n[inverse]
    done = np.concatenate(([0], np.cumsum(own)))
    ids = flat[np.repeat(place[inverse] - done[:-1], own) + np.arange(done[-1])] if len(own) else np.empty(0, np.int32)
    at = done[cuts]
    return np.insert(ids, at[1:], subwords.end), at + np.arange(len(at))


def windows(offsets: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, filled, first position scored) of the windows over sequences at ``offsets``."""
    lengths = np.diff(offsets)
    step = WINDOW - context
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, offsets[text] + k * step, np.minimum(WINDOW, lengths[text] - k * step), np.where(k == 0, 0, context)


class Before:
    """Log probabilities of the next group, and of the next class in its group, by the class before: from counts."""

    def __init__(self, pairs: np.ndarray, bias: np.ndarray):
        """``pairs`` [class, next class]; ``bias``: log frequencies of the classes."""
        alone = np.exp(bias).reshape(GROUPS, MEMBERS)
        group = alone.sum(1)
        pairs = pairs.reshape(CLASSES, GROUPS, MEMBERS).astype(np.float64)
        groups = pairs.sum(2)
        self.groups = np.log((groups + SMOOTH * group / group.sum()) / (groups.sum(1, keepdims=True) + SMOOTH)).astype(np.float32)
        members = (pairs + SMOOTH * alone / group[:, None]) / (groups[..., None] + SMOOTH)
        self.members = np.log(members).astype(np.float32).reshape(CLASSES * GROUPS, MEMBERS)
        self.seen, self.seen_groups = (groups.sum(1) + SMOOTH).astype(np.float32), (groups + SMOOTH).astype(np.float32).ravel()

    def without(self, last: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What taking one occurrence of each pair out of the counts adds to the target's two log probabilities, but for a shift that
        all share."""
        place = last * GROUPS + targets // MEMBERS
        counts = np.exp(self.groups.ravel().take(place)) * self.seen.take(last), np.exp(self.members.ravel().take(last * CLASSES + targets)) * self.seen_groups.take(place)
        return tuple(np.log(np.maximum(1 - 1 / c, 1e-4)) for c in counts)


_ONES = np.ones(WINDOW, np.float32)
_LAG = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_SEEN = _LAG >= 0
_CUTS = np.cumsum([KEY, KEY, STATE])
#: e: vectors of classes; t: to queries, keys, values and own states; r: by distance; w, u: to groups and members.
_SHAPES = {"e": (CLASSES, D), "t": (D, 2 * KEY + 2 * STATE), "r": (WINDOW,), "w": (STATE, GROUPS), "u": (GROUPS, STATE, MEMBERS)}


class Attention:
    """Causal self-attention over classes that gives the next one in two steps, on top of ``before``.

    The query, key, value and own state of a position depend on its class alone, and on distances by ``r``, so
    they are rows of tables that are worked out once for all windows.
    """

    def __init__(self, params: dict[str, np.ndarray], before: Before):
        self.p, self.before = params, before

    @classmethod
    def fresh(cls, before: Before, seed: int = 5) -> Attention:
        r = np.random.default_rng(seed)
        scale = {"e": 1.0, "t": D**-0.5, "r": 0.0, "w": 0.02, "u": 0.02}
        p = {k: (r.normal(0, 1, shape) * scale[k]).astype(np.float32) for k, shape in _SHAPES.items()}
        p["t"][:, :KEY] *= np.float32(KEY**-0.5)
        return cls(p, before)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in _SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray, before: Before) -> Attention:
        p, at = {}, 0
        for k, shape in _SHAPES.items():
            n = int(np.prod(shape))
            p[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return cls(p, before)

    def table(self) -> np.ndarray:
        return self.p["e"] @ self.p["t"]

    def states(self, rows: np.ndarray, table: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """[window, position, state] for input rows [window, position]; no position sees a later one."""
        x = table.take(rows.ravel(), axis=0).reshape(*rows.shape, -1)
        q, k, v, own = (x[..., a:b] for a, b in zip((0, *_CUTS), (*_CUTS, None), strict=True))
        s = q @ k.transpose(0, 2, 1)
        s += np.where(_SEEN, self.p["r"][np.maximum(_LAG, 0)], -1e9).astype(s.dtype)
        if s.max(initial=0) > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        whole = 1 / (s @ _ONES.astype(s.dtype))[..., None]
        if keep is None:
            m = s @ v
            m *= whole
        else:
            s *= whole
            m = s @ v
            keep.update(q=q, k=k, v=v, s=s, m=m)
        h = own + m
        np.maximum(h, 0, out=h)
        if keep is not None:
            keep["h"] = h
        return h

    def log_probs(self, h: np.ndarray, last: np.ndarray, targets: np.ndarray, grads: dict | None = None, counted: bool = False) -> np.ndarray:
        """Natural log probability of each target class after the class ``last``, from its state. With ``grads``: the gradients of
        their mean's negative are put there, that of the states as ``h``. ``counted``: the counts hold these very pairs, so each is
        judged without itself."""
        p, n = self.p, len(h)
        order = np.argsort((targets // MEMBERS).astype(np.uint8), kind="stable")  # by group from here on
        h, last, targets = h.take(order, axis=0), last.take(order), targets.take(order)
        group = targets // MEMBERS
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        spans = [(g, lo, hi) for g, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
        y = h @ p["w"]
        y += self.before.groups.take(last, axis=0)
        x = np.empty((n, MEMBERS), h.dtype)
        for g, lo, hi in spans:
            np.matmul(h[lo:hi], p["u"][g], out=x[lo:hi])
        x += self.before.members.take(last * GROUPS + group, axis=0)
        every = np.arange(n)
        at_y, at_x = every * GROUPS + group, every * MEMBERS + (targets - group * MEMBERS)
        if counted:
            for z, at, less in zip((y, x), (at_y, at_x), self.before.without(last, targets), strict=True):
                z.ravel()[at] += less
        for z in (y, x):
            if n and (z.max() > 80 or z.min() < -80):
                z -= z.max(1, keepdims=True)
        found = y.ravel().take(at_y) + x.ravel().take(at_x)
        np.exp(y, out=y)
        np.exp(x, out=x)
        groups, members = y @ np.ones(GROUPS, y.dtype), x @ np.ones(MEMBERS, x.dtype)
        found -= np.log(groups * members)
        out = np.empty_like(found)
        out[order] = found
        if grads is not None:
            y *= (1 / (groups * n))[:, None]
            x *= (1 / (members * n))[:, None]
            y.ravel()[at_y] -= 1 / n
            x.ravel()[at_x] -= 1 / n
            grads |= {"w": h.T @ y, "u": np.zeros_like(p["u"])}
            back = y @ p["w"].T
            for g, lo, hi in spans:
                np.matmul(h[lo:hi].T, x[lo:hi], out=grads["u"][g])
                back[lo:hi] += x[lo:hi] @ p["u"][g].T
            grads["h"] = np.empty_like(back)
            grads["h"][order] = back
        return out

    def grads(self, rows: np.ndarray, keep: dict, dh: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters below the states, from those of the states."""
        dx = dh * (keep["h"] > 0)
        s = keep["s"]
        ds = dx @ keep["v"].transpose(0, 2, 1)
        ds -= np.einsum("...i,...i->...", dx, keep["m"])[..., None]
        ds *= s
        dr = np.bincount(_LAG[_SEEN], ds.sum(0)[_SEEN], WINDOW)
        d = np.empty((*rows.shape, 2 * KEY + 2 * STATE), dh.dtype)
        q, k, v, own = (d[..., a:b] for a, b in zip((0, *_CUTS), (*_CUTS, None), strict=True))
        np.matmul(ds, keep["k"], out=q)
        np.matmul(ds.transpose(0, 2, 1), keep["q"], out=k)
        np.matmul(s.transpose(0, 2, 1), dx, out=v)
        own[...] = dx
        d, row = d.reshape(-1, d.shape[-1]), rows.ravel()
        place = (row[:, None] * D + np.arange(D)).ravel()
        de = np.bincount(place, (d @ self.p["t"].T).ravel(), CLASSES * D).reshape(CLASSES, D)
        return {"e": de.astype(d.dtype), "t": self.p["e"].take(row, axis=0).T @ d, "r": dr.astype(d.dtype)}

    def train(self, n: int, windows_of, rate: float = 0.01, seed: int = 1) -> None:
        """Adam steps, in batches, over ``n`` windows: ``windows_of`` numbers gives their classes, the classes that follow
        (both [window, position]) and the flat places that count."""
        r, batch = np.random.default_rng(seed), max(FEW, min(BATCH, n // STEPS))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        order = np.concatenate([r.permutation(n) for _ in range(max(1, -(-STEPS * batch // n)))])
        steps = -(-len(order) // batch)
        for t in range(1, steps + 1):
            keep, grads = {}, {}
            x, targets, ok = windows_of(order[(t - 1) * batch : t * batch])
            h = self.states(x, self.table(), keep).reshape(-1, STATE)
            self.log_probs(h.take(ok, axis=0), x.ravel().take(ok), targets.ravel().take(ok), grads, counted=True)
            dh = np.zeros_like(h)
            dh[ok] = grads.pop("h")
            now = np.float32(rate * (1 - 0.9 * t / steps) / (1 - 0.9**t))
            for k, g in (grads | self.grads(x, keep, dh.reshape(*x.shape, STATE))).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] = self.p[k] - now * m[k] / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)


class Classes:
    """Class and log10 probability inside its class of every subword, from their counts."""

    def __init__(self, counts: np.ndarray, end: int, starts_word: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        order = np.concatenate(([end], order[order != end]))
        smooth = counts.astype(np.float64) + 1
        own, rest = order[: CLASSES - BINS], order[CLASSES - BINS :]
        self.cls = np.empty(len(counts), np.int16)
        # a group holds subwords that start a word or ones that don't, as common as each other
        self.cls[own[np.argsort(~starts_word[own], kind="stable")]] = np.arange(len(own))
        for half, flag in enumerate((True, False)):
            part = rest[starts_word[rest] == flag]
            mass = np.cumsum(smooth[part])
            self.cls[part] = len(own) + half * BINS // 2 + np.minimum(BINS // 2 - 1, (mass - smooth[part] / 2) / mass[-1] * (BINS // 2)).astype(np.int16)
        mass = np.bincount(self.cls, smooth, CLASSES)
        self.inside = np.log10(smooth / mass[self.cls])
        self.bias = np.log(np.maximum(mass, 1e-9) / mass.sum())


def score_classes(cls: np.ndarray, offsets: np.ndarray, model: Attention, many: int = 64) -> np.ndarray:
    """log10 probability of each text's sequence of classes; its last one is an end."""
    cls = cls.astype(np.int64)
    rows = np.concatenate((cls[-1:], cls[:-1]))  # the end of the text before starts the next
    out = np.zeros(len(offsets) - 1)
    text, start, filled, first = windows(offsets)
    place, table = np.arange(WINDOW), model.table()
    for skip in (0, CONTEXT):  # later windows only score what the ones before haven't
        order = np.nonzero(first == skip)[0]
        order = order[np.argsort(filled[order] < WINDOW, kind="stable")]
        for at in range(0, len(order), many):
            own = order[at : at + many]
            index = np.minimum(start[own][:, None] + place, len(cls) - 1)
            x = rows.take(index)
            h, last, targets = model.states(x, table)[:, skip:].reshape(-1, STATE), x[:, skip:].ravel(), cls.take(index[:, skip:].ravel())
            number = np.repeat(text[own], WINDOW - skip)
            if filled[own[-1]] < WINDOW:
                ok = np.nonzero((place[skip:] < filled[own][:, None]).ravel())[0]
                h, last, targets, number = h.take(ok, axis=0), last.take(ok), targets.take(ok), number.take(ok)
            out += np.bincount(number, model.log_probs(h, last, targets), len(out)) / np.log(10)
    return out


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _count(path: str):
    def run(batches):
        """(kind, key, n): words by hash (kind 0, key 0 kind 2: ends), subwords by id (kind 1)."""
        held, total = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        subwords = Subwords(path)
        ids = np.zeros(subwords.size, np.int64)
        for batch in batches:
            for _, part in tokens.batches_of(batch.column("text"), _CHUNK):
                low, starts, ends, hashes, _ = words_of(*tokens.column_bytes(part))
                unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
                flat, place, sizes = subwords.of(unique, low, starts[first], ends[first])
                done = np.cumsum(sizes)
                own = flat[np.repeat(place - done + sizes, sizes) + np.arange(done[-1] if len(done) else 0)]
                ids += np.bincount(own, np.repeat(n, sizes), len(ids)).astype(np.int64)
                total += len(part)
                held.append((unique, n))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [_summed(held)]
        keys, counts = _summed(held)
        ids[subwords.end] = total
        seen = np.nonzero(ids)[0]
        kinds = np.concatenate((np.zeros(len(keys)), np.ones(len(seen)), np.full(1, 2))).astype(np.int8)
        for at in range(0, len(kinds), 50_000):
            to = at + 50_000
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds[at:to]), pa.array(np.concatenate((keys.view(np.int64), seen, [0]))[at:to]), pa.array(np.concatenate((counts, ids[seen], [total])).astype(np.int64)[at:to])], names=["kind", "key", "n"]
            )

    return run


def _code(path: str, classes, common):
    """Per text its classes, the log10 probability of its subwords in their classes, and what the base needs."""
    names = ["id", "rid", "held", "n_tokens", "known", "logs", "inside", "rare", "classes"]
    rare_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())]))

    def run(batches):
        subwords, (keys, logs), c = Subwords(path), common.value, classes.value
        for batch in batches:
            for at, part in tokens.batches_of(batch.column("text"), _CHUNK):
                low, starts, ends, hashes, cuts = words_of(*tokens.column_bytes(part))
                ids, offsets = sequences(low, starts, ends, hashes, cuts, subwords)
                inside = np.add.reduceat(c.inside[ids], offsets[:-1])
                text = np.repeat(np.arange(len(part)), np.diff(cuts))
                slot = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[slot] == hashes if len(keys) else np.zeros(len(hashes), bool)
                known = np.bincount(text[hit], minlength=len(part))
                sums = np.bincount(text[hit], logs[slot[hit]] if len(keys) else None, len(part)).astype(float)
                by = np.lexsort((hashes[~hit], text[~hit]))
                t, h = text[~hit][by], hashes[~hit][by]
                new = np.nonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (h[1:] != h[:-1]))))[0] if len(t) else np.empty(0, np.int64)
                n = np.diff(np.concatenate((new, [len(t)]))).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(n)], fields=list(rare_type.value_type))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(t[new], np.arange(len(part) + 1)).astype(np.int32)), rare).cast(rare_type)
                coded = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((offsets * 2).astype(np.int32).tobytes()), pa.py_buffer(c.cls[ids].tobytes())])
                kept = [batch.column(k).slice(at, len(part)) for k in ("id", "rid", "held")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(cuts) + 1), pa.array(known), pa.array(sums), pa.array(inside), rare, coded], names=names)

    return run


_CODED = "id long, rid long, held boolean, n_tokens long, known long, logs double, inside double, rare array<struct<key:long,n:int>>, classes binary"


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tokens.column_bytes(column)
    return data.view(np.int16), offsets // 2


def _pairs(batches):
    """Counts of neighbouring classes, by blocks of classes before."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for _, part in tokens.batches_of(batch.column("classes"), _CHUNK):
            cls, offsets = _classes(part)
            cls = cls.astype(np.int32)
            total += np.bincount(np.concatenate((cls[-1:], cls[:-1])) * CLASSES + cls, minlength=len(total))
    blocks = total.astype(np.int32 if total.max() < 1 << 31 else np.int64).reshape(CLASSES * CLASSES // (4 * _BLOCK), -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "part"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.int32 if len(p) == 16 * _BLOCK else np.int64).astype(np.int64) for p in pdf["part"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [total.tobytes()]})


def _joined(blocks: DataFrame, dtype) -> np.ndarray | None:
    """The array that blocks of fixed number make up."""
    found = sorted(blocks.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["part"], dtype) for r in found]) if found else None


def _train(flat, before, turn: int):
    def run(batches):
        held: list[tuple] = []  # two bytes a subword, nine a window; the windows themselves are built step by step
        total = 0
        for batch in batches:
            for _, part in tokens.batches_of(batch.column("classes"), _CHUNK):
                cls, offsets = _classes(part)
                _, start, filled, _ = windows(offsets, 0)
                held.append((cls, start + total, filled.astype(np.int8)))
                total += len(cls)
        if not held:
            return
        cls, start, filled = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        start, filled = start[turn::ROUNDS], filled[turn::ROUNDS]
        if not len(start):
            return
        place, n = np.arange(WINDOW), len(start)

        def windows_of(own: np.ndarray):
            index = np.minimum(start[own][:, None] + place, total - 1)
            # the last subword, an end, stands before the first
            return cls.take(index - 1, mode="wrap").astype(np.int64), cls.take(index).astype(np.int64), np.nonzero((place < filled[own][:, None]).ravel())[0]

        model = Attention.of(flat.value, before.value)
        model.train(n, windows_of, seed=turn)
        new, weight = model.flat(), float(filled.sum(dtype=np.int64))
        blocks = range(0, len(new), _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // _BLOCK for b in blocks], pa.int32()), pa.array([weight] * len(blocks)), pa.array([new[b : b + _BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "weight", "part"]
        )

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(w * np.frombuffer(p, np.float32).astype(np.float64) for w, p in zip(pdf["weight"], pdf["part"], strict=True))
    weight = pdf["weight"].sum()
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "weight": [weight], "part": [(total / weight).astype(np.float32).tobytes()]})


def fit(coded: DataFrame, classes: Classes) -> Attention:
    """Count neighbours in, and train on, every row (classes): rounds of local steps and averages."""
    spark = coded.sparkSession
    pairs = _joined(sum_in_levels(coded.mapInArrow(_pairs, "block int, part binary"), _add), np.int64)
    before = Before(np.zeros(CLASSES * CLASSES, np.int64) if pairs is None else pairs, classes.bias)
    shared, model = spark.sparkContext.broadcast(before), Attention.fresh(before)
    for turn in range(ROUNDS):
        flat = spark.sparkContext.broadcast(model.flat())
        parts = coded.mapInArrow(_train(flat, shared, turn), "block int, weight double, part binary")
        new = _joined(sum_in_levels(parts, _average), np.float32)  # the parameters, whatever the input
        if new is not None:
            model = Attention.of(new, before)
    return model


def _score(model):
    names = ["id", "rid", "held", "n_tokens", "known", "logs", "score"]

    def run(batches):
        for batch in batches:
            for at, part in tokens.batches_of(batch.column("classes"), _CHUNK):
                scores = score_classes(*_classes(part), model.value)
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in names[:-1]), pa.array(scores + own.column("inside").to_numpy())], names=names)

    return run


def _commonest(words: DataFrame, most: int) -> DataFrame:
    """The words whose count reaches the lowest bound, in sixteenths of powers of two, that at most ``most`` words reach."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)  # 1008 rows at most
    total, least = 0, None
    for own, n in sizes:
        total += n
        if total > most:
            break
        least = own
    return words.where(level >= least) if least is not None else words.limit(0)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Per row: identifier, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learnt from rows whose crc32(id as text) mod 7 is not 2 (null identifiers are learnt from). Null and empty texts are
    one end. Words are told apart by a 64-bit hash. ``tokenizer`` is a file of ranks that every node can read. Other
    columns aren't read; repeated rows give repeated results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod("id", 7) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text")).withColumn("held", held)
    counts = materialise(rows.where("not held").select("text").mapInArrow(_count(tokenizer), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    ids = counts.where("kind = 1").select("key", "n").toPandas()  # one row per subword id at most
    words = counts.where("kind = 0")
    total = counts.agg(F.sum(F.when(F.col("kind") != 1, F.col("n"))).alias("n"), F.count_if(F.col("kind") == 0).alias("v"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).head()
    ends = total["ends"] or 0
    n, v = total["n"] or 0, total["v"] + (ends > 0)
    floor = float(np.log10(n + v + 1))
    subwords = Subwords(tokenizer)
    end = subwords.end
    by_id = np.zeros(end + 1, np.int64)
    by_id[ids["key"].to_numpy(np.int64)] = ids["n"].to_numpy(np.int64)
    classes = Classes(by_id, end, subwords.starts)
    top = _commonest(words, COMMON_WORDS).select("key", "n").toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    share = spark.sparkContext.broadcast
    common = share((keys[order], np.log10(top["n"].to_numpy(np.float64)[order] + 1)))
    coded = materialise(rows.mapInArrow(_code(tokenizer, share(classes), common), _CODED), "lm-coded")
    model = fit(coded.where("not held").select("classes"), classes)
    scored = coded.drop("rare").mapInArrow(_score(share(model)), "id long, rid long, held boolean, n_tokens long, known long, logs double, score double")
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.key").alias("key"), F.col("r.n").alias("tf"))
    tail = rare.join(words.select("key", "n"), "key").groupBy("rid").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("tail_logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        scored.join(tail, "rid", "left").select(
            F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + zero("tail_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("logs") + zero("tail_logs") + float(np.log10(ends + 1)) - F.col("n_tokens") * floor).alias("base_score"), "score",
        )
    )
