"""Queries of the text, extraction and matching operators, and their SQL.

``orders`` stand for recordings and ``lineitem`` for their entries; lists are rendered as text first and then parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import extract, lateral, text
from cuewright.operators import hash_index, matching, similarity
from cuewright.sources import render
from cuewright.sources.tables import Tables


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries that a task holds at most, about.
TASK_ROWS = 250_000


def _small_tasks(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` dealt by ``key`` to so many tasks that none holds much over ``TASK_ROWS``, if the session's number is too small for ``count`` rows.
    What groups by ``key`` and more takes them as they lie."""
    tasks = -(-count // TASK_ROWS)
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_id, ord, start_sec, artist, title, score, price: an entry per line item (repeated line numbers are told apart by ``ord``)."""
    li, pa, su = (_t(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    w, count = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), li.count()
    rows = _small_tasks(li, "l_orderkey", count).withColumn("ord", F.row_number().over(w)).join(pa.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(su.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = rows.select(
        F.col("l_orderkey").alias("mix_id"), "ord", (F.col("ord") * 217).cast("double").alias("start_sec"), F.col("s_name").alias("artist"), F.col("p_name").alias("title"),
        (1 - F.col("l_discount") * 4).alias("score"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("int").alias("quantity"),
    )
    return _small_tasks(named, "mix_id", count)


_LI_SQL = """
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
n AS (SELECT l_orderkey AS mix_id, ord, (ord * 217)::DOUBLE AS start_sec, s_name AS artist, p_name AS title, 1 - l_discount * 4 AS score, l_extendedprice AS price, l_quantity::INTEGER AS quantity
  FROM l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _lists(rows: DataFrame, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """One text per recording, a line per entry."""
    grouped = rows.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return grouped.select("mix_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit(tail)).alias("text"))


def _timed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    line = F.concat(F.when(F.col("ord") % 3 == 0, F.concat("ord", F.lit(". "))).otherwise(F.lit("")), text.clock("start_sec"), F.when(F.col("ord") % 2 == 0, F.lit(" - ")).otherwise(F.lit(" ")), "artist", F.lit(" – "), "title")
    return _lists(rows, line, "Recorded live\n", "\nthanks")


def parse_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.timed_lines(_timed_texts(spark, sf_dir), "text", "mix_id", "youtube_description").select("mix_id", "ord", "start_sec", "artist", "title", "source")


def list_entries_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists by the table function, in SQL."""
    lateral.register(spark)
    return spark.sql("SELECT d.mix_id, e.* FROM {docs} d, LATERAL list_entries(d.text, 'timed') e", docs=_timed_texts(spark, sf_dir))


TIMED_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord, start_sec, artist, title, 'youtube_description' AS source FROM n"

LATERAL_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord::INTEGER AS pos, start_sec, artist, title FROM n"


def parse_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    line = F.concat(F.when(F.col("ord") % 2 == 0, F.concat("ord", F.lit(") "))).otherwise(F.lit("- ")), F.regexp_replace("artist", "[-–—|]", " "), F.lit(" - "), "title")
    return extract.untimed_lines(_lists(rows, line, "Tracklist:\n"), "text", "mix_id", "youtube_description_untimed").select("mix_id", "ord", "artist", "title", "source")


UNTIMED_SQL = f"""WITH {_LI_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY mix_id) AS many FROM n)
SELECT mix_id, ord, regexp_replace(artist, '[-–—|]', ' ', 'g') AS artist, title, 'youtube_description_untimed' AS source FROM m WHERE many >= 5"""


def parse_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    title = F.when(F.col("ord") == 1, F.lit("Intro")).otherwise(F.concat(F.lpad(F.col("ord").cast("string"), 2, "0"), F.lit(". "), "artist", F.lit(" - "), "title"))
    chapter = F.struct("ord", F.col("start_sec").alias("start_time"), (F.col("start_sec") + 217).alias("end_time"), title.alias("title"))
    meta = rows.groupBy("mix_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(chapter)).alias("chapters"))).alias("meta"))
    return extract.chapters(meta, "meta", "mix_id", "youtube_chapters")


CHAPTERS_SQL = f"WITH {_LI_SQL} SELECT mix_id, (ord - 1)::INTEGER AS ord, start_sec, artist, title, 'youtube_chapters' AS source FROM n WHERE ord > 1"


def parse_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    line = F.concat(F.lit("# [["), F.regexp_replace("artist", "[-–—|]", " "), F.lit("]] - [["), "title", F.lit("]]"))
    return extract.wiki_tracks(_lists(rows, line, "== Notes ==\n# Not - This\n== Tracklist ==\n", "\n== Comments ==\n# Nor - That"), "text", "mix_id").select("mix_id", F.col("ord") - 2, "artist", "title", "source").toDF("mix_id", "ord", "artist", "title", "source")


WIKI_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord, regexp_replace(artist, '[-–—|]', ' ', 'g') AS artist, title, 'mixesdb' AS source FROM n"


def tracklist_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    line = F.concat(F.lit('<div id="tlp_'), "ord", F.lit('"><span class="cueValueField">'), text.clock("start_sec"), F.lit('</span><span class="trackValue">'), "artist", F.lit(" - "), "title", F.lit("</span></div>"))
    return extract.tracklist_pages(_lists(rows, line, "<html><body><div>", "</div></body></html>"), "text", "mix_id").select("mix_id", "start_sec", "artist", "title", "source")


HTML_SQL = f"WITH {_LI_SQL} SELECT mix_id, start_sec, artist, title, '1001tracklists' AS source FROM n"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_links(_t(spark, sf_dir, "pages"), "html", "page_id", 3)


LINKS_SQL = r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), 1) AS pos FROM pages),
x AS (SELECT page_id, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(tag, '>([^<]*)</a>', 1), '\s+', ' ', 'g')) AS anchor FROM t),
f AS (SELECT page_id, href, min(pos) AS pos, arg_min(anchor, pos) AS anchor FROM x GROUP BY 1, 2),
k AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, href, anchor FROM f) SELECT * FROM k WHERE rank <= 3"""


def og_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no such tags, so each gets two before it is read."""
    tagged = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<meta property="og:title" content="p'), "page_id", F.lit('"><meta name="twitter:title" content="t">'), "html").alias("html"))
    return tagged.select("page_id", F.explode(extract.meta_tags(F.col("html"))).alias("m")).select("page_id", "m.name", "m.content")


OG_SQL = "SELECT page_id, 'og:title' AS name, 'p' || page_id AS content FROM pages UNION ALL SELECT page_id, 'twitter:title', 't' FROM pages"


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.concat(F.lit("https://open.Spotify.com/us/"), "page_id", F.lit("?si=1#x"))
    apple = F.concat(F.lit("HTTPS://music.apple.com/us/album/"), "page_id", F.lit("?l=2"))
    tube = F.concat(F.lit(" https://www.youtube.com/watch?v="), "page_id")
    return _t(spark, sf_dir, "pages").select(
        "page_id", text.url_host("url").alias("host"), text.url_cache_key("url").alias("cache_key"), text.url_cache_key(share).alias("share_key"), text.url_cache_key(apple).alias("apple_key"),
        text.url_kind(tube).alias("kind"), text.url_kind("url").alias("no_kind"), text.has_host(share, text.LOCKED_HOSTS).alias("locked"), text.has_host("url", text.SUPPORTED_HOSTS).alias("supported"),
    )


URL_SQL = r"""SELECT page_id, replace(lower(regexp_extract(url, '^https?://([^/]+)/', 1)), 'www.', '') AS host,
lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS cache_key,
'https://open.spotify.com/us/' || page_id AS share_key, 'https://music.apple.com/album/' || page_id AS apple_key, 'youtube' AS kind, NULL::VARCHAR AS no_kind, true AS locked, false AS supported FROM pages"""


def clean_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = text.clean_phrase("text")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", phrase.alias("phrase"), text.phrase_passes(phrase).alias("passes"))


PHRASE_SQL = r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM conversations),
p AS (SELECT *, list_filter(list_transform(string_split_regex(flat, '[.,!?;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
b AS (SELECT conv_id, turn, coalesce(left(list_sort(list_transform(parts, lambda x, i: struct_pack(n := -length(x), i := i, p := x)))[1].p, 120), flat) AS phrase FROM p)
SELECT conv_id, turn, phrase, len(string_split(phrase, ' ')) >= 5 AND len(list_distinct(string_split(lower(phrase), ' '))) >= 4 AS passes FROM b"""


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.token_overlap(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "item_id", "text", "doc_id", "body", 5)
    return out.withColumn("score", F.round("score", 6))


OVERLAP_SQL = """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), qw AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM q),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents),
s AS (SELECT item_id, doc_id, round(count(*) / greatest(n, 1), 6) AS score FROM qw JOIN d USING (word) GROUP BY item_id, doc_id, n),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 5"""


def library_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every twentieth vector, as 32-bit hashes in two variants, against all vectors."""
    return similarity.top_matches(*_stretches(spark, sf_dir), 3, 0.5).withColumn("score", F.round("score", 9))


def _stretches(spark: SparkSession, sf_dir: str, factor: int = 1) -> tuple[DataFrame, DataFrame]:
    bits = lambda v: F.pmod(F.floor(v.cast("double") * 65536) * factor, F.lit(4294967296)).cast("long")
    lib = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.transform("embedding", bits).alias("hashes"))
    asks = lib.where("track_id % 20 = 0").select(F.col("track_id").alias("query_id"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.slice("hashes", 9, 24).alias("h")), F.struct(F.lit(1).alias("o"), F.slice("hashes", 20, 24).alias("h")))).alias("v"))
    return asks.select("query_id", F.col("v.o").alias("pitch_ord"), F.col("v.h").alias("hashes")), lib


TOPK_SQL = """WITH lib AS (SELECT vec_id AS track_id, list_transform(embedding, lambda v: ((floor(v::DOUBLE * 65536)::BIGINT % 4294967296) + 4294967296) % 4294967296) AS h FROM embeddings),
q AS (SELECT track_id AS query_id, 0 AS o, h[9:32] AS q FROM lib WHERE track_id % 20 = 0 UNION ALL SELECT track_id, 1, h[20:43] FROM lib WHERE track_id % 20 = 0),
a AS (SELECT query_id, o, track_id, unnest(generate_series(0, len(h) - 24)) AS off, q, h FROM q, lib),
s AS (SELECT query_id, o, track_id, off, 1 - list_sum(list_transform(generate_series(1, 24), lambda i: bit_count(xor(q[i], h[off + i])))) / (24 * 32) AS score FROM a),
b AS (SELECT query_id, o, track_id, coalesce(arg_min(struct_pack(s := score, f := off), off) FILTER (score > 0.97), arg_max(struct_pack(s := score, f := off), (score, -off))) AS b FROM s GROUP BY 1, 2, 3),
p AS (SELECT query_id, track_id, arg_max(b, (b.s, -o)) AS b FROM b GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b.s DESC, track_id) AS rank, track_id, round(b.s, 9) AS score, b.f::INTEGER AS "offset" FROM p WHERE b.s >= 0.5)
SELECT * FROM r WHERE rank <= 3"""


def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every twentieth vector against a stored index of all vectors, at a floor of 0.9; the hashes' bits are mixed, as a
    fingerprint's are."""
    asks, lib = _stretches(spark, sf_dir, 2654435761)
    path = Tables(spark, "index").folder
    hash_index.build_index(lib, path)
    return hash_index.indexed_matches(asks, spark, path, 3, 0.9).withColumn("score", F.round("score", 9))


INDEX_SQL = TOPK_SQL.replace("b.s >= 0.5", "b.s >= 0.9").replace("floor(v::DOUBLE * 65536)::BIGINT %", "floor(v::DOUBLE * 65536)::BIGINT * 2654435761 %")


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 0 passes on its three best, the others their first hit."""
    rows = entries(spark, sf_dir).withColumns({"segment": F.floor((F.col("ord") - 1) / 5).cast("int"), "stage": F.col("quantity") % 4, "source": F.concat(F.lit("m"), (F.col("quantity") % 4).cast("string"))})
    return matching.cascade(rows, ["mix_id", "segment"], rank="ord", keep={0: 3})


CASCADE_SQL = f"""WITH {_LI_SQL}, m AS (SELECT mix_id, ((ord - 1) // 5)::INTEGER AS segment, quantity % 4 AS stage, ord, artist, title, score FROM n),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY mix_id, segment, stage ORDER BY ord) <= CASE WHEN stage = 0 THEN 3 ELSE 1 END),
w AS (SELECT f.*, (SELECT max(score) FROM f e WHERE e.mix_id = f.mix_id AND e.segment = f.segment AND e.stage < f.stage) AS best FROM f)
SELECT mix_id, segment, stage, (row_number() OVER (PARTITION BY mix_id, segment ORDER BY stage, ord) - 1)::INTEGER AS candidate_index, artist, title, score, 'm' || stage AS source FROM w WHERE best IS NULL OR best < 0.85"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumns({"segment": F.floor((F.col("ord") - 1) / 3).cast("int"), "candidate_index": ((F.col("ord") - 1) % 3).cast("int"), "source": F.lit("library")})
    return rows.select("mix_id", "segment", "candidate_index", "artist", "title", "score", "source")


_CAND_SQL = "c AS (SELECT mix_id, ((ord - 1) // 3)::INTEGER AS segment, ((ord - 1) % 3)::INTEGER AS candidate_index, artist, title, score, 'library' AS source FROM n)"
_BEST_SQL = "SELECT mix_id, segment, max_by(candidate_index, (score, -candidate_index)) AS candidate_index, max_by(artist, (score, -candidate_index)) AS artist, max_by(title, (score, -candidate_index)) AS title, max(score) AS score, 'library' AS source FROM {rows} GROUP BY mix_id, segment HAVING max(score) >= {floor}"


def greedy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy_pick(_candidates(spark, sf_dir), ["mix_id", "segment"], floor=0.7)


GREEDY_SQL = f"WITH {_LI_SQL}, {_CAND_SQL} {_BEST_SQL.format(rows='c', floor=0.7)}"


def apply_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for every third recording names the last candidate of segment 0 and drops segment 1."""
    rows = _candidates(spark, sf_dir)
    answer = F.lit('Sure: {"picks": [{"segment_index": 0, "candidate_index": 5}, {"segment_index": 0, "candidate_index": -1}, {"segment_index": 1, "candidate_index": null}]} done')
    picks = extract.model_picks(rows.where("mix_id % 3 = 0").select("mix_id").distinct().withColumn("answer", answer), "answer", "mix_id").withColumnRenamed("segment_index", "segment")
    return matching.apply_picks(rows, picks, "mix_id", "segment")


PICKS_SQL = f"""WITH {_LI_SQL}, {_CAND_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY mix_id, segment) AS n FROM c),
a AS (SELECT *, mix_id % 3 = 0 AND max(n) OVER (PARTITION BY mix_id) > 1 AND segment < 2 AS picked FROM k), g AS (SELECT * FROM a WHERE NOT picked)
SELECT mix_id, segment, candidate_index, artist, title, score, source FROM a WHERE picked AND segment = 0 AND candidate_index = n - 1 UNION ALL {_BEST_SQL.format(rows='g', floor=0.5)}"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("ord <= 7").select("mix_id", ((F.col("ord") - 4) * 2).cast("int").alias("pitch"), "score")


def expanding_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.expanding_best(_variants(spark, sf_dir), ["mix_id"])


PITCH_SQL = f"""WITH {_LI_SQL}, v AS (SELECT mix_id, ((ord - 4) * 2)::INTEGER AS pitch, score FROM n WHERE ord <= 7), o AS (SELECT *, abs(pitch) * 2 + (pitch > 0)::INTEGER AS o FROM v),
b AS (SELECT mix_id, coalesce(arg_min(struct_pack(p := pitch, s := score), o) FILTER (score >= 0.85), arg_max(struct_pack(p := pitch, s := score), (score, -o)) FILTER (score >= 0.8)) AS b FROM o GROUP BY 1)
SELECT mix_id, b.p AS pitch, b.s AS score FROM b WHERE b IS NOT NULL"""


def upper_median_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.upper_median_gate(_variants(spark, sf_dir), ["mix_id"])


MEDIAN_SQL = f"""WITH {_LI_SQL}, g AS (SELECT mix_id, max(score) AS best, list_sort(list(score)) AS s FROM n WHERE ord <= 7 GROUP BY 1)
SELECT mix_id, best, s[len(s) // 2 + 1] AS median FROM g WHERE best >= 0.8 AND s[len(s) // 2 + 1] >= 0.65"""


def tier2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even entries are tracks, odd ones unknown; the matches lie a little later."""
    rows = entries(spark, sf_dir).withColumns({"end_sec": F.col("start_sec") + 217, "source": F.lit("shazam")})
    matches = rows.where("ord % 3 = 1").select("mix_id", F.col("ord") + 1000, (F.col("start_sec") + 250).alias("start_sec"), (F.col("end_sec") + 100).alias("end_sec"), "artist", "title", "score", (F.col("quantity") - 25).alias("pitch")).toDF("mix_id", "ord", "start_sec", "end_sec", "artist", "title", "score", "pitch")
    tracks, left = matching.tier2_merge(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1").select("mix_id", "ord", "start_sec", "end_sec"), matches, "mix_id")
    return tracks.select("mix_id", "ord", "start_sec", "source").unionByName(left.select("mix_id", "ord", "start_sec", F.lit("unknown").alias("source")))


TIER2_SQL = f"""WITH {_LI_SQL}, t AS (SELECT *, start_sec + 217 AS end_sec FROM n), u AS (SELECT * FROM t WHERE ord % 2 = 1),
m AS (SELECT mix_id, ord + 1000 AS ord, start_sec + 250 AS start_sec, end_sec + 100 AS end_sec, 'tier2:acoustid_vocals(pitch=' || printf('%+d', quantity - 25) || '%)' AS source FROM t WHERE ord % 3 = 1 AND score >= 0.85),
a AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM u WHERE u.mix_id = m.mix_id AND m.start_sec < u.end_sec AND u.start_sec < m.end_sec))
SELECT mix_id, ord, start_sec, 'shazam' AS source FROM t WHERE ord % 2 = 0 UNION ALL SELECT mix_id, ord, start_sec, source FROM a
UNION ALL SELECT mix_id, ord, start_sec, 'unknown' FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE u.mix_id = a.mix_id AND a.start_sec < u.end_sec AND u.start_sec < a.end_sec)"""


def dedup_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("artist", F.lit("x"))
    loud = rows.where("ord > 2").withColumn("title", F.concat(F.upper("title"), F.lit("!")))
    return matching.drop_known_names(loud, rows.where("ord <= 2"), "mix_id").select("mix_id", "ord", "title")


UNTIMED_DEDUP_SQL = f"""WITH {_LI_SQL}, k AS (SELECT mix_id, ord, upper(title) || '!' AS title, regexp_replace(lower(title), '[^\\w\\s]', '', 'g') AS t FROM n),
f AS (SELECT mix_id, ord, title, row_number() OVER (PARTITION BY mix_id, t ORDER BY ord) AS r FROM k WHERE ord > 2 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.mix_id = k.mix_id AND b.ord <= 2 AND b.t = k.t))
SELECT mix_id, ord, title FROM f WHERE r = 1"""


def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one kind are the library, all parts the batch; every seventh pair of parts shares a path."""
    part = _t(spark, sf_dir, "part").select(F.concat(F.lit("/m/"), F.floor(F.col("p_partkey") / 7), F.lit("/"), F.least(F.col("p_partkey") % 7, F.lit(5))).alias("filepath"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    own = part.where("p_size <= 25").groupBy("filepath").agg(F.min("id").alias("id"), F.min_by("title", "id").alias("title"))
    return matching.library_upsert(own, part.drop("p_size"), "filepath", "id")


UPSERT_SQL = """WITH p AS (SELECT '/m/' || (p_partkey // 7) || '/' || least(p_partkey % 7, 5) AS filepath, p_partkey AS id, p_name AS title, p_size FROM part),
l AS (SELECT filepath, min(id) AS id, arg_min(title, id) AS title FROM p WHERE p_size <= 25 GROUP BY 1)
SELECT * FROM l UNION ALL SELECT filepath, max(id), arg_max(title, id) FROM p WHERE filepath NOT IN (SELECT filepath FROM l) GROUP BY filepath"""


def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("artist"), F.upper("p_type").alias("title"), F.col("p_partkey").alias("id"), F.concat(F.lit("/m/"), "p_partkey").alias("filepath"))
    tracks = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.concat(F.lit(" "), "p_brand").alias("artist"), F.col("p_type").alias("title"))
    return matching.library_lookup(tracks, part.where("id % 3 = 0"), "id").select("track", "filepath")


LOOKUP_SQL = """SELECT p.p_partkey AS track, l.filepath FROM part p LEFT JOIN (SELECT lower(p_brand) AS a, lower(p_type) AS t, '/m/' || max(p_partkey) AS filepath FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2) l
ON lower(p.p_brand) = l.a AND lower(p.p_type) = l.t"""


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    rows = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    now = rows.agg(F.max("ts").alias("now"))
    return matching.ttl_cache(rows.crossJoin(F.broadcast(now)), "user_id", F.col("now"), 7 * 86_400e6).select("user_id", "event_id")


TTL_SQL = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 7 * 86400 * 1000000::BIGINT"


def artist_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_per_group(entries(spark, sf_dir), "artist", 3, F.desc("price"), F.col("mix_id"), F.col("ord")).select("artist", "rank", "title", "price")


TOPN_SQL = f"WITH {_LI_SQL}, k AS (SELECT artist, row_number() OVER (PARTITION BY artist ORDER BY price DESC, mix_id, ord) AS rank, title, price FROM n) SELECT * FROM k WHERE rank <= 3"


def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pages_of(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size")), "size")


PAGED_SQL = "SELECT p_partkey, p_size AS size, i::INTEGER AS page_no, least(25, p_size - i * 25)::INTEGER AS page_size FROM part, LATERAL (SELECT unnest(generate_series(0, (p_size + 24) // 25 - 1)) AS i) WHERE p_size > 0"


def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("duration"), F.col("o_custkey").alias("identified"))
    return matching.usage_stats(runs).withColumn("total_duration", F.round("total_duration", 2))


USAGE_SQL = "SELECT count(*) AS total_runs, round(coalesce(sum(o_totalprice), 0), 2) AS total_duration, coalesce(sum(o_custkey), 0)::BIGINT AS total_tracks FROM orders"


def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.when(F.col("o_orderkey") % 4 == 0, "pending").when(F.col("o_orderkey") % 4 == 1, "running").otherwise("done").alias("status"))
    return matching.queue_state(jobs, "queue")


QUEUE_SQL = """WITH d AS (SELECT o_custkey AS queue, count(*) FILTER (o_orderkey % 4 < 2) AS depth FROM orders GROUP BY 1)
SELECT queue, depth, CASE WHEN depth = 0 THEN 'free' WHEN depth <= 2 THEN 'busy' ELSE 'swamped' END AS state, floor(30 * (depth + 0.5))::BIGINT AS eta_minutes FROM d"""


def parse_matcher_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered recogniser answers, read back."""
    rows = entries(spark, sf_dir)
    names = F.array(F.struct(F.col("artist").alias("name")), F.struct(F.lit("Guest").alias("name")))
    kind = "struct<score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>>>>"
    none = F.struct(F.lit(0.1).alias("score"), F.lit(None).cast("array<string>").alias("recordings"))
    one = F.struct("score", F.array(F.struct(F.lit("r").alias("id"), "title", names.alias("artists"))).alias("recordings")).cast(kind)
    acoustid = F.to_json(F.struct(F.lit("ok").alias("status"), F.array(F.from_json(F.to_json(none), kind), one).alias("results")))
    acr = F.to_json(F.struct(F.struct(F.when(F.col("ord") == 2, 1001).otherwise(0).alias("code")).alias("status"), F.struct(F.array(F.struct("title", names.alias("artists"), F.round(F.col("score") * 100).alias("score"))).alias("music")).alias("metadata")))
    genius = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("mix_id").alias("id"), "title", F.struct(F.col("artist").alias("name")).alias("primary_artist")).alias("result"))).alias("hits")).alias("response")))
    shazam = F.to_json(F.struct(F.struct("title", F.array(F.struct(F.array(F.struct(F.lit("ISRC").alias("title"), F.lit("old").alias("text")), F.struct(F.lit("isrc").alias("title"), F.concat(F.lit("I"), "ord").alias("text"))).alias("metadata"))).alias("sections")).alias("track")))
    out = rows.select("mix_id", "ord", extract.acoustid_match(acoustid).alias("a"), extract.acrcloud_match(acr).alias("c"), extract.genius_hit(genius).alias("g"), extract.shazam_isrc(shazam).alias("isrc"))
    return out.select("mix_id", "ord", F.col("a.title").alias("title"), F.col("a.artist").alias("artist"), F.round("a.score", 6).alias("score"), F.col("c.score").alias("cloud_score"), F.col("g.artist").alias("hit_artist"), "isrc")


MATCHER_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord, title, artist || ', Guest' AS artist, round(score, 6) AS score, CASE WHEN ord <> 2 THEN round(score * 100) / 100 END AS cloud_score, artist AS hit_artist, 'I' || ord AS isrc FROM n"


def hmac_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.hmac_sha1("url", "secret").alias("signature"))


#: HMAC by its definition: the key filled up to 64 bytes, xored with 0x36 and with 0x5c.
HMAC_SQL = (
    "WITH h AS (SELECT page_id, sha1(unhex('" + bytes(b ^ 0x36 for b in b"secret".ljust(64, b"\0")).hex() + "') || encode(url)) AS inner_ FROM pages) "
    "SELECT page_id, base64(unhex(sha1(unhex('" + bytes(b ^ 0x5C for b in b"secret".ljust(64, b"\0")).hex() + "') || unhex(inner_)))) AS signature FROM h"
)


def render_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    unknown = rows.where("ord % 4 = 0").select("mix_id", "ord", "start_sec")
    return render.text_list(rows.where("ord % 4 <> 0"), unknown, "mix_id")


TXT_SQL = f"""WITH {_LI_SQL}, lns AS (SELECT mix_id, start_sec, ord, CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END AS kind,
  CASE WHEN start_sec >= 3600 THEN printf('%02d:%02d:%02d', start_sec::BIGINT // 3600, start_sec::BIGINT % 3600 // 60, start_sec::BIGINT % 60) ELSE printf('%02d:%02d', start_sec::BIGINT // 60, start_sec::BIGINT % 60) END AS c,
  CASE WHEN ord % 4 = 0 THEN '[unidentified]' ELSE artist || ' - ' || title || printf(' (%.2f)', round(score, 2)) END AS body FROM n)
SELECT mix_id, string_agg(c || '  ' || body, chr(10) ORDER BY start_sec, kind, ord) AS text FROM lns GROUP BY mix_id"""


def render_m3u(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("end_sec", F.col("start_sec") + 200)
    library = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("artist"), F.lit("none").alias("title"), F.col("s_suppkey").alias("id"), F.lit("/m").alias("filepath"))
    return render.playlist(matching.library_lookup(rows, library, "id"), "mix_id")


M3U_SQL = f"WITH {_LI_SQL} SELECT mix_id, '#EXTM3U' || chr(10) || string_agg('#EXTINF:200,' || artist || ' - ' || title || chr(10), chr(10) ORDER BY start_sec, ord) AS text FROM n GROUP BY mix_id"


def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumns({"end_sec": F.col("start_sec") + 200, "source": F.lit("library"), "n_merged": F.lit(1)})
    return render.json_result(rows.where("ord % 4 <> 0"), rows.where("ord % 4 = 0").select("mix_id", "ord", "start_sec", "end_sec"), "mix_id")


JSON_SQL = f"""WITH {_LI_SQL}, o AS (SELECT mix_id, ord, start_sec, start_sec + 200 AS e, artist, title, round(score, 3) AS score FROM n),
t AS (SELECT mix_id, string_agg('{{"start_sec":' || start_sec || ',"end_sec":' || e || ',"artist":"' || artist || '","title":"' || title || '","score":' || score || ',"source":"library","n_segments_merged":1}}', ',' ORDER BY start_sec, ord) FILTER (ord % 4 <> 0) AS t,
  string_agg('{{"start_sec":' || start_sec || ',"end_sec":' || e || '}}', ',' ORDER BY start_sec, ord) FILTER (ord % 4 = 0) AS u FROM o GROUP BY mix_id)
SELECT mix_id, '{{"source_input":"' || mix_id || '","tracks":[' || coalesce(t, '') || '],"unknown_segments":[' || coalesce(u, '') || ']}}' AS json FROM t"""


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (parse_timed, TIMED_SQL), (list_entries_sql, LATERAL_SQL), (parse_untimed, UNTIMED_SQL), (parse_chapters, CHAPTERS_SQL), (parse_wikitext, WIKI_SQL), (tracklist_html, HTML_SQL), (page_links, LINKS_SQL), (og_tags, OG_SQL), (url_functions, URL_SQL),
        (clean_phrases, PHRASE_SQL), (token_overlap, OVERLAP_SQL), (library_topk, TOPK_SQL), (library_index, INDEX_SQL), (cascade, CASCADE_SQL), (greedy_pick, GREEDY_SQL), (apply_picks, PICKS_SQL), (expanding_pitch, PITCH_SQL), (upper_median_gate, MEDIAN_SQL),
        (tier2_merge, TIER2_SQL), (dedup_untimed, UNTIMED_DEDUP_SQL), (library_upsert, UPSERT_SQL), (library_lookup, LOOKUP_SQL), (ttl_cache, TTL_SQL), (artist_topn, TOPN_SQL), (paged_scan, PAGED_SQL), (usage_stats, USAGE_SQL),
        (queue_state, QUEUE_SQL), (parse_matcher_json, MATCHER_SQL), (hmac_sign, HMAC_SQL), (render_txt, TXT_SQL), (render_m3u, M3U_SQL), (render_json, JSON_SQL),
    )
}
