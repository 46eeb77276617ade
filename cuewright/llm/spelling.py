"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point.

One half of a word meets its near words unchanged: the first, or the last, depending on where they differ. So words go to tasks twice, by
their first and by their last signs. A task builds the minimal automaton of its words (read backwards for last signs), follows each word's
half exactly and completes it with one error; what both directions could find counts forwards only. Groups of words too large for a task are
split by longer halves, then by halving the part that holds the error and requiring what is on both sides of it, until groups are small: at
the last step they share all signs but one place, so only the alphabet limits them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.automata import build, signs, within_one
from cuewright.llm.common import materialise, scratch, text_or_empty

LEAST_SIGNS, LEAST_TIMES, RATIO, DROP = 7, 2, 10, 31
#: Signs that route a word: no half of a word of ``LEAST_SIGNS`` is shorter.
ROUTE = LEAST_SIGNS // 2
#: Words of a group that needn't be split, and rows of words in a task.
GROUP, TASK = 60_000, 60_000
#: Queries followed at a time.
BATCH = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, some with a sign dropped by hash, of enough signs and occurrences."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(F.col(f"`{text_col}`")), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_SIGNS},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    low = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % DROP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))).otherwise(F.col("run"))
    return low.select(word.alias("word")).where(F.length("word") >= LEAST_SIGNS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def _exact(length: Column) -> Column:
    """Signs of a query that one direction follows exactly: the first half forwards, the other backwards."""
    half = F.floor(length / 2).cast("int")
    return F.when(F.col("back"), length - half).otherwise(half)


def _routed(words: DataFrame, group: int) -> DataFrame:
    """(back, w, n, lo, hi, ask, key): each word, read in a direction, as data and, where ``ask``, as a query with an error in [lo, hi)."""
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word", "n").select("back", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("w"), "n")
    size = F.length("w")
    rows = both.select("back", "w", "n", size.alias("of"), _exact(size).alias("lo"), size.alias("hi"), F.lit(True).alias("ask"), F.xxhash64("back", F.substring("w", 1, ROUTE)).alias("key"))
    parts = []
    first = True
    while True:
        big = materialise(rows.where(F.lit(first) | (F.col("hi") - F.col("lo") > 1)).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group), "spell-big")
        columns = ("back", "w", "n", "lo", "hi", "ask", "key")
        if big.isEmpty():
            parts.append(rows.select(*columns))
            break
        parts.append(rows.join(big, "key", "left_anti").select(*columns))
        hot = rows.join(big, "key", "left_semi")
        if first:  # as data for queries of each length that may be near
            asked = hot.select("back", "w", "n", F.explode(F.filter(F.array(size - 1, size, size + 1), lambda x: x >= LEAST_SIGNS)).alias("of"))
            spans = asked.select("back", "w", "n", "of", _exact(F.col("of")).alias("lo"), F.col("of").alias("hi"))
        else:
            middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
            spans = hot.select("back", "w", "n", "of", F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("s")).select("back", "w", "n", "of", "s.*")
        right = F.col("of") - F.col("hi")
        key = F.xxhash64("back", "of", "lo", "hi", F.substring("w", F.lit(1), F.col("lo")), F.substring("w", size - right + 1, right))
        rows = materialise(spans.select("back", "w", "n", "of", "lo", "hi", (F.col("of") == size).alias("ask"), key.alias("key")), "spell-split")
        first = False
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _search(table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the queries of one task's words."""
    back = table.column("back")[0].as_py()
    w, n, ask = table.column("w").to_pylist(), table.column("n").to_numpy(), table.column("ask").to_numpy(zero_copy_only=False)
    counts = dict(zip(w, n.tolist(), strict=True))
    words = sorted(counts)
    auto = build(words)
    own = np.array([counts[x] for x in words])
    rank = np.empty(len(words), np.int64)  # in the order of the words as written
    rank[sorted(range(len(words)), key=lambda i: words[i][::-1]) if back else np.arange(len(words))] = np.arange(len(words))
    rows = np.nonzero(ask)[0]
    lo, hi = table.column("lo").to_numpy().astype(np.int64), table.column("hi").to_numpy().astype(np.int64)
    out: list[list] = [[], [], [], []]
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        asked = [w[i] for i in part]
        q, found = within_one(auto, *signs(asked), lo[part], hi[part])
        if back:  # the forward search has those whose first half is shared
            halves = [x[len(x) - len(x) // 2 :] for x in asked]
            keep = np.fromiter((not words[f].endswith(halves[i]) for i, f in zip(q.tolist(), found.tolist(), strict=True)), bool, len(q))
            q, found = q[keep], found[keep]
        if not len(q):
            continue
        by = np.lexsort((rank[found], -own[found], q))
        q, found = q[by], found[by]
        lead = np.nonzero(np.concatenate(([True], q[1:] != q[:-1])))[0]
        turn = (lambda x: x[::-1]) if back else (lambda x: x)
        out[0] += [turn(asked[i]) for i in q[lead].tolist()]
        out[1] += np.diff(np.concatenate((lead, [len(q)]))).tolist()
        out[2] += own[found[lead]].tolist()
        out[3] += [turn(words[i]) for i in found[lead].tolist()]
    return pa.table([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, group: int = GROUP, task: int = TASK) -> DataFrame:
    """(word, n_near, best_n, best) of distinct ``words`` (word, n) that have near words: how many, and of the largest n the smallest."""
    rows = materialise(_routed(words, group), "spell-rows")
    tasks = max(1, -(-rows.count() // task))
    shard = rows.withColumn("shard", F.pmod("key", F.lit(tasks)) * 2 + F.col("back").cast("int")).drop("key")
    found = shard.groupBy("shard").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, task: int = TASK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts.

    ``form`` is a word's near word of largest n, the smallest of equals in code-point order, if that n is ten times the word's or more.
    ``root`` is where following forms ends; n grows tenfold at each step, so chains are short. Null and empty texts have no words, a null
    identifier counts as empty text in the hash, repeated rows count each time; an empty table gives no rows. ``group`` and ``task`` bound
    what a task holds, they don't change the result. The result's tables stay in the shared folder.
    """
    with scratch(docs.sparkSession):
        words = materialise(word_counts(docs, id_col, text_col), "spell-words")
        near = words.join(near_words(words, group, task), "word", "left")
        sure = F.col("best_n") >= RATIO * F.col("n")
        graph = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(sure, F.col("best")).alias("form"), F.when(sure, F.col("best_n")).alias("form_n")), "spell-graph", keep=True)
        links = materialise(graph.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spell-links")
        while True:
            ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
            links = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spell-roots", keep=True)
            if links.where("moved").isEmpty():
                break
    return graph.join(links.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
