"""Minimal acyclic automata of sorted words as numpy arrays, with perfect-hash word numbers, and search within one error.

States hold how many words they lead to, so the sum of what a path skips is the number of its word in the sorted list. All words are
added, and all queries followed, a sign at a time together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a code point in an edge's key.
SIGN_BITS = 21
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(seed)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words, where each starts, lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.cumsum(lengths) - lengths, lengths


@dataclass
class Automaton:
    """``keys`` are state and sign of each edge, in order; ``first`` where a state's edges start; ``skip`` how many words the edge leaves behind."""

    keys: np.ndarray
    target: np.ndarray
    skip: np.ndarray
    first: np.ndarray
    final: np.ndarray
    start: int

    def step(self, state: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is an edge, which)."""
        if not len(self.keys):
            return np.zeros(len(state), bool), np.zeros(len(state), np.int64)
        key = (state << SIGN_BITS) | sign
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at


def build(words: list[str]) -> Automaton:
    """The minimal automaton of distinct words in code-point order."""
    flat, off, length = signs(words)
    n = len(words)
    # signs that each word shares with the one before
    shared = np.zeros(n, np.int64)
    alike = np.arange(1, n)
    depth = 0
    while len(alike):
        alike = alike[(length[alike] > depth) & (length[alike - 1] > depth)]
        alike = alike[flat[off[alike] + depth] == flat[off[alike - 1] + depth]]
        shared[alike] += 1
        depth += 1
    # the trie, level by level: a level's edges by parent, then sign, since the words are sorted
    node, nodes, active, depth = np.zeros(n, np.int64), 1, np.arange(n), 0
    parents, labels, levels = [], [], []
    while len(active := active[length[active] > depth]):
        new = shared[active] <= depth
        parents.append(node[active[new]])
        labels.append(flat[off[active[new]] + depth])
        node[active] = nodes + np.cumsum(new) - 1
        levels.append(nodes)
        nodes += int(new.sum())
        depth += 1
    parent, label = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parents, labels))
    final = np.zeros(nodes, bool)
    final[node] = True
    below = np.bincount(node, minlength=nodes)
    degree = np.bincount(parent, minlength=nodes)
    child = np.arange(1, nodes)  # the edge that made a node is the one before it
    for seed in _SEEDS:
        mark = final.astype(np.uint64) * np.uint64(seed >> 7)
        if seed == _SEEDS[0]:
            count = below.copy()
        for lo, hi in reversed(list(zip(levels, [*levels[1:], nodes], strict=True))):
            own = slice(lo - 1, hi - 1)
            if seed == _SEEDS[0]:
                np.add.at(count, parent[own], count[lo:hi])
            np.add.at(mark, parent[own], _mix(_mix(mark[lo:hi], seed) + label[own].astype(np.uint64) * np.uint64(seed), seed))
        _, chosen, kind = np.unique(mark, return_index=True, return_inverse=True)
        like = chosen[kind]
        at = np.cumsum(degree) - degree
        order = np.argsort(parent, kind="stable")
        p, c, s = parent[order], child[order], label[order]
        if (degree == degree[like]).all() and (final == final[like]).all():
            twin = at[like[p]] + np.arange(len(p)) - at[p]
            if (s == s[twin]).all() and (kind[c] == kind[c[twin]]).all():
                break  # states that share a mark do have equal edges
    else:
        raise RuntimeError("no mark tells the states apart")
    keep = like[p] == p
    state, sign, target = kind[p[keep]], s[keep], kind[c[keep]]
    by = np.argsort((state << SIGN_BITS) | sign)
    state, sign, target = state[by], sign[by], target[by]
    first = np.searchsorted(state, np.arange(len(chosen) + 1))
    leads = count[chosen][target]
    before = np.cumsum(leads) - leads
    skip = before - (before[first[state]] if len(state) else 0) + final[chosen][state]
    return Automaton((state << SIGN_BITS) | sign, target, skip, first, final[chosen], int(kind[0]))


def within_one(auto: Automaton, flat: np.ndarray, off: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of all words that differ from a query by one error whose place is in [lo, hi) or, where hi is the query's end, at
    the end. The place is the first that differs, so a pair has one place. Queries' first ``lo`` signs are followed exactly."""
    n = len(off)
    state, number = np.full(n, auto.start, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    fq = fs = fp = fn = np.empty(0, np.int64)  # the completions: query, state, place, number
    depth = 0
    while len(alive) or len(fq):
        if len(fq):
            ended = fp == length[fq]
            hit = ended & auto.final[fs]
            found.append((fq[hit], fn[hit]))
            fq, fs, fp, fn = (x[~ended] for x in (fq, fs, fp, fn))
            there, at = auto.step(fs, flat[off[fq] + fp])
            at = at[there]
            fq, fs, fp, fn = fq[there], auto.target[at], fp[there] + 1, fn[there] + auto.skip[at]
        if not len(alive):
            continue
        inside = (lo[alive] <= depth) & ((depth < hi[alive]) | ((depth == length[alive]) & (hi[alive] == length[alive])))
        q = alive[inside]
        if len(q):
            more = depth < length[q]  # at the end of the query there is only insertion
            sign = np.where(more, flat[np.minimum(off[q] + depth, len(flat) - 1)], -1)
            s, num = state[q], number[q]
            fan = auto.first[s + 1] - auto.first[s]
            row = np.repeat(np.arange(len(q)), fan)
            edge = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + auto.first[s[row]]
            other = (auto.keys[edge] & ((1 << SIGN_BITS) - 1)) != sign[row] if len(edge) else np.empty(0, bool)
            row, edge = row[other], edge[other]
            t, tn = auto.target[edge], num[row] + auto.skip[edge]
            swap = more[row]
            later = np.minimum(off[q] + depth + 1, len(flat) - 1)
            gone = more & ((depth + 1 == length[q]) | (flat[later] != sign))  # of equal signs in a row, the last goes
            place = np.full(len(row), depth)
            fq = np.concatenate((fq, q[row], q[row[swap]], q[gone]))
            fs = np.concatenate((fs, t, t[swap], s[gone]))
            fp = np.concatenate((fp, place, place[swap] + 1, np.full(int(gone.sum()), depth + 1)))
            fn = np.concatenate((fn, tn, tn[swap], num[gone]))
        alive = alive[(depth < length[alive]) & (depth < hi[alive])]
        if len(alive):
            there, at = auto.step(state[alive], flat[off[alive] + depth])
            alive, at = alive[there], at[there]
            state[alive] = auto.target[at]
            number[alive] += auto.skip[at]
        depth += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
