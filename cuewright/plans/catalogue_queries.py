"""Queries of the catalogue operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import extract
from cuewright.operators import catalogue, matching, overlay, timeline
from cuewright.plans.text_queries import _LI_SQL, _t, entries
from cuewright.plans.timeline_queries import _DAY_SQL, _OVERLAY_SQL, _known_unknown, day_results, durations


def title_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page names its artist in the title, in the description or as a musician."""
    kind = F.col("page_id") % 3
    title = F.when(kind == 0, F.concat(F.lit("Song "), "page_id", F.lit(" BY Band"))).otherwise(F.concat(F.lit("Song "), "page_id"))
    head = F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('">'), F.when(kind == 1, F.lit('<meta property="og:description" content="Duo · Song · 2024">')).when(kind == 2, F.lit('<meta property="music:musician" content="https://x/the-trio">')).otherwise(F.lit("")))
    rows = _t(spark, sf_dir, "pages").select("page_id", catalogue.title_artist(extract.meta_tags(F.concat(head, "html"))).alias("t"))
    return rows.select("page_id", "t.title", "t.artist", "t.query")


TITLE_SQL = """WITH t AS (SELECT page_id, 'Song ' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 'Band' WHEN 1 THEN 'Duo' ELSE 'the trio' END AS artist FROM pages) SELECT *, title || ' ' || artist AS query FROM t"""


def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered search answers of three kinds, read back."""
    rows = entries(spark, sf_dir)
    url = F.concat(F.lit("http://x/"), "ord")
    grouped = lambda value: rows.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))).alias("x"))
    values = F.transform("x", lambda e: e["v"])
    songs = grouped(F.struct(F.col("artist").alias("artistName"), F.col("title").alias("trackName"), F.when(F.col("ord") != 2, url).alias("previewUrl"))).select("mix_id", F.to_json(F.struct(values.alias("results"))).alias("a"))
    lines = grouped(F.when(F.col("ord") == 2, F.lit("{bad")).otherwise(F.to_json(F.struct(F.concat(F.lit("v"), "ord").alias("id"), "title", F.col("start_sec").alias("duration"))))).select("mix_id", F.array_join(values, "\n").alias("a"))
    wiki = grouped(F.struct("title", url.alias("url"))).select("mix_id", F.to_json(F.array(F.to_json(F.transform(values, lambda v: v["title"])), F.to_json(F.transform(values, lambda v: v["url"])))).alias("a"))
    wiki = wiki.select("mix_id", F.concat(F.lit('["q",'), F.get(F.from_json("a", "array<string>"), F.lit(0)), F.lit(",[],"), F.get(F.from_json("a", "array<string>"), F.lit(1)), F.lit("]")).alias("a"))
    a = catalogue.preview_hits(songs, "a", "mix_id", "itunes").select("mix_id", "pos", F.col("source").alias("kind"), "title", F.col("preview").alias("url"))
    b = catalogue.json_lines(lines, "a", "mix_id", "youtube").select("mix_id", "pos", F.col("platform").alias("kind"), "title", "url")
    c = catalogue.opensearch_hits(wiki, "a", "mix_id").select("mix_id", "pos", F.lit("mixesdb").alias("kind"), "title", "url")
    return a.unionByName(b).unionByName(c)


SEARCH_SQL = f"""WITH {_LI_SQL}, f AS (SELECT mix_id, (ord - 1)::INTEGER AS pos, title, ord FROM n)
SELECT mix_id, pos, 'itunes' AS kind, title, 'http://x/' || ord AS url FROM f WHERE ord <> 2 UNION ALL SELECT mix_id, pos, 'youtube', title, 'https://www.youtube.com/watch?v=v' || ord FROM f WHERE ord <> 2
UNION ALL SELECT mix_id, pos, 'mixesdb', title, 'http://x/' || ord FROM f"""


def next_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<p><script id="__NEXT_DATA__" type="x">{"props":{"b":[{"title":"'), "p_name", F.lit('","url":"u1"},{"title":"t2","url":"u2"},{"title":"t3"}]}}</script>')).alias("html"))
    return catalogue.next_data(part, "html", "p_partkey", ("$.props.a", "$.props.b"), 2)


NEXT_SQL = "SELECT p_partkey, 0 AS pos, p_name AS title, 'u1' AS url FROM part UNION ALL SELECT p_partkey, 1, 't2', 'u2' FROM part"


def ranked_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    asks = rows.where("ord = 1").select("mix_id", F.concat("title", F.lit(" "), "artist").alias("query"))
    found = rows.select("mix_id", "ord", "title", (F.col("quantity") * 20).cast("double").alias("duration_sec"))
    return catalogue.ranked_mirrors(asks, found, "mix_id").withColumn("score", F.round("score", 6))


MIRROR_SQL = f"""WITH {_LI_SQL}, q AS (SELECT mix_id, list_distinct(regexp_extract_all(lower(title || ' ' || artist), '[a-z0-9]+')) AS q FROM n WHERE ord = 1),
s AS (SELECT mix_id, ord, title, quantity * 20.0::DOUBLE AS duration_sec, len(list_intersect(q, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')))) / greatest(len(q), 1) * CASE WHEN quantity * 20 < 300 THEN 0.6 ELSE 1.0 END AS score FROM n JOIN q USING (mix_id))
SELECT mix_id, ord, title, duration_sec, round(score, 6) AS score, row_number() OVER (PARTITION BY mix_id ORDER BY score DESC, ord) AS rank FROM s"""


def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumns({"segment": F.floor((F.col("ord") - 1) / 3).cast("int"), "candidate_index": ((F.col("ord") - 1) % 3).cast("int"), "source": F.lit("library"), "score": F.round("score", 2)})
    return catalogue.prompts(rows, "mix_id", "segment")


PROMPT_SQL = f"""WITH {_LI_SQL}, b AS (SELECT mix_id, (ord - 1) // 3 AS segment, string_agg('  [' || ((ord - 1) % 3) || '] ' || artist || ' - ' || title || printf(' (score %.2f, library)', round(score, 2)), chr(10) ORDER BY ord) AS b FROM n GROUP BY 1, 2)
SELECT mix_id, string_agg('Segment ' || segment::INTEGER || ':' || chr(10) || b, chr(10) || chr(10) ORDER BY segment) AS prompt FROM b GROUP BY 1"""


def playlist_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.playlist_requests(entries(spark, sf_dir), "mix_id", 3)


REQUEST_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord, ((row_number() OVER (PARTITION BY mix_id ORDER BY start_sec, ord) - 1) // 3)::INTEGER AS chunk_no, 'track:' || title || ' artist:' || artist AS strict, artist || ' ' || title AS loose FROM n"


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are listed by two timed, an untimed and a late source, by their quantity; few recordings have no timed one."""
    rows = entries(spark, sf_dir).select("mix_id", "ord", "title", "quantity")
    part = lambda *k: rows.where((F.col("quantity") % 8).isin(*k)).drop("quantity")
    return catalogue.union_sources([part(0), part(1)], [part(2, 3, 4, 5)], [part(6, 7)], "mix_id")


UNION_SQL = f"""WITH {_LI_SQL}, k AS (SELECT mix_id, ord, title, [0, 1, 2, 2, 2, 2, 3, 3][quantity % 8 + 1] AS src_rank FROM n)
SELECT * FROM k WHERE src_rank <> 2 OR mix_id NOT IN (SELECT mix_id FROM k WHERE src_rank < 2)"""


def stem_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of every other error entry are recognised by the entry's own event."""
    unknown = timeline.longest_unknowns(_known_unknown(spark, sf_dir)[1], "mix_id")
    found = unknown.where("ord % 2 = 0").select("mix_id", "ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("stem"), F.concat(F.lit("a"), "ord").alias("artist"), F.lit("t").alias("title")).withColumn("score", 0.5 + F.col("stem") / 4)
    rescued, left = catalogue.stem_retry(unknown, found, "mix_id")
    return rescued.select("mix_id", "ord", "segment_index", "artist", "score").unionByName(left.select("mix_id", "ord", F.col("pos").alias("segment_index"), F.lit(None).cast("string").alias("artist"), F.lit(None).cast("double").alias("score")))


RETRY_SQL = f"""WITH {_DAY_SQL}, u AS (SELECT mix_id, ord, end_sec - start_sec AS n, row_number() OVER (PARTITION BY mix_id ORDER BY start_sec - end_sec, ord) <= 20 AS retry FROM r WHERE source = 'error'),
o AS (SELECT *, retry AND ord % 2 = 0 AND n >= 8 AS ok FROM u)
SELECT mix_id, ord, -row_number() OVER (PARTITION BY mix_id ORDER BY ord) AS segment_index, 'a' || ord AS artist, 0.5::DOUBLE AS score FROM o WHERE ok
UNION ALL SELECT mix_id, ord, row_number() OVER (PARTITION BY mix_id ORDER BY retry, ord), NULL, NULL FROM o WHERE NOT ok"""


def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("running_sec"), F.when(F.col("o_orderkey") % 3 == 0, " True").when(F.col("o_orderkey") % 3 == 1, "0").alias("with_demucs"))
    tracks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("end_sec"))
    return catalogue.job_stats(jobs, tracks, "job")


JOB_SQL = """WITH t AS (SELECT l_orderkey AS job, count(*) AS identified, count(DISTINCT l_returnflag) AS sources, max(l_quantity) AS last FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job, coalesce(identified, 0) AS identified, coalesce(sources, 0) AS sources, coalesce(last, o_totalprice) AS duration, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS deep_scan FROM orders LEFT JOIN t ON job = o_orderkey"""


def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).withColumn("artist", F.when(F.col("ord") != 2, F.col("artist")))
    out = catalogue.as_candidates(rows.select("mix_id", "ord", "artist", "title", "score", F.col("quantity").alias("pitch")), "acoustid", "mix_id", "ord")
    return out.select("mix_id", "ord", "artist", "title", "score", "source", F.try_element_at("extra", F.lit("pitch")).alias("pitch"))


POOL_SQL = f"WITH {_LI_SQL} SELECT mix_id, ord, CASE WHEN ord = 2 THEN '' ELSE artist END AS artist, title, score, 'acoustid' AS source, quantity::VARCHAR AS pitch FROM n"


def overlay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five overlay rules: names, inserts, ends, unknowns that listed entries explain, untimed entries that no track has."""
    rows = day_results(spark, sf_dir)
    return overlay.overlay(rows.where("source = 'view'").withColumn("n_merged", F.lit(1).cast("long")), rows.where("source in ('purchase', 'signup')"), rows.where("source in ('click', 'view')"), rows.where("source = 'error'"), durations(rows), "mix_id", 1800.0)


_TAIL_SQL = """
t AS (SELECT mix_id, ord, artist, title, source, row_number() OVER (PARTITION BY mix_id, lower(artist), lower(title) ORDER BY ord) AS k FROM r WHERE source IN ('click', 'view')),
f AS (SELECT * FROM t WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM ends m WHERE m.mix_id = t.mix_id AND m.artist = t.artist AND m.title = t.title)),
u AS (SELECT mix_id, ord, start_sec, end_sec, (start_sec + end_sec) / 2 AS m FROM r WHERE source = 'error'),
b AS (SELECT u.mix_id, u.ord, max(s.start_sec) FILTER (s.start_sec <= m) AS lo, min(s.start_sec) FILTER (s.start_sec >= m) AS hi FROM u JOIN r s ON s.mix_id = u.mix_id AND s.source IN ('purchase', 'signup') GROUP BY 1, 2)"""
WHOLE_SQL = f"""WITH {_DAY_SQL}, {_OVERLAY_SQL}, {_TAIL_SQL}
SELECT * FROM ends UNION ALL SELECT mix_id, 86399.0, 86400.0, artist, title, 1.0, source, 1 FROM f
UNION ALL SELECT u.mix_id, u.start_sec, u.end_sec, NULL, NULL, NULL, 'unknown', 0 FROM u LEFT JOIN b USING (mix_id, ord) WHERE NOT coalesce(hi - lo <= 1800, false)"""


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (title_artist, TITLE_SQL), (search_answers, SEARCH_SQL), (next_data, NEXT_SQL), (ranked_mirrors, MIRROR_SQL), (render_prompts, PROMPT_SQL), (playlist_requests, REQUEST_SQL), (union_sources, UNION_SQL),
        (stem_retry, RETRY_SQL), (job_stats, JOB_SQL), (candidate_pools, POOL_SQL), (overlay_whole, WHOLE_SQL),
    )
}
