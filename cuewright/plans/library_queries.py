"""Queries of the library operators, the small text functions and the resolution end to end, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import extract, signal, text
from cuewright.operators import catalogue, library, matching, resolution, timeline
from cuewright.plans.text_queries import _LI_SQL, _t, entries
from cuewright.plans.timeline_queries import _DAY_SQL, _OVERLAY_SQL, _RUNS_SQL, _SMOOTH_CTE, day_entries, day_results, durations
from cuewright.sources import answers, audio, library_table, render
from cuewright.sources.tables import Tables


def chart_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of each recording's entries; every sixth has no preview, and charts are cut at 5."""
    rows = entries(spark, sf_dir)
    track = F.struct((F.col("mix_id") * 100 + F.col("ord")).alias("id"), "title", F.when(F.col("quantity") % 6 > 0, F.concat(F.lit("p"), "ord")).alias("preview"), F.struct(F.col("artist").alias("name")).alias("artist"))
    charts = rows.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("ord", track.alias("t")))).alias("x")).select("mix_id", F.to_json(F.struct(F.transform("x", lambda e: e["t"]).alias("data"))).alias("answer"))
    return library.chart_tracks(charts, "answer", "mix_id", 5)


CHART_SQL = f"""WITH {_LI_SQL} SELECT mix_id, (ord - 1)::INTEGER AS pos, mix_id * 100 + ord AS id, 'deezer:' || (mix_id * 100 + ord) AS uri, artist, title, '' AS album, 'p' || ord AS preview FROM n WHERE ord <= 5 AND quantity % 6 > 0"""


def artist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top two tracks of every artist in a comma list a nation."""
    lists = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), " , ,").alias("names"))
    top = matching.top_per_group(entries(spark, sf_dir), "artist", 2, F.desc("price"), F.col("mix_id"), F.col("ord"))
    return library.artist_union(lists, "names", "s_nationkey").join(top.select("artist", "rank", "title"), "artist").select("s_nationkey", "artist", "rank", "title")


UNION_SQL = f"""WITH {_LI_SQL}, k AS (SELECT artist, title, row_number() OVER (PARTITION BY artist ORDER BY price DESC, mix_id, ord) AS rank FROM n)
SELECT s_nationkey, artist, rank, title FROM supplier JOIN k ON s_name = artist WHERE rank <= 2"""


def typed_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("/m/"), "p_partkey").alias("filepath"), F.col("p_size").alias("n_hashes"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "p_type")
    return library_table.as_library(part).select("id", "filepath", "title", "artist", "n_hashes", "album").where("title is not null")


TYPED_SQL = "SELECT p_partkey AS id, '/m/' || p_partkey AS filepath, p_name AS title, p_brand AS artist, p_size AS n_hashes, NULL::VARCHAR AS album FROM part"


def library_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.library_size(_t(spark, sf_dir, "part"))


SIZE_SQL = "SELECT count(*) AS tracks FROM part"


def library_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of parts, then a batch of line items' parts, whose paths are known but for every seventh, which come several times."""
    path = Tables(spark, "library").folder
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/m/"), "p_partkey").alias("filepath"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_size").alias("n_hashes"))
    later = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("/new/"), "l_partkey")).otherwise(F.concat(F.lit("/m/"), "l_partkey")).alias("filepath"), F.lit("later").alias("title"), F.lit("x").alias("artist"), F.lit(1).alias("n_hashes"))
    library_table.upsert_library(part, path)
    library_table.upsert_library(later, path)
    return library_table.read_library(spark, path).select("id", "filepath", "title", "artist", "n_hashes")


BUILD_SQL = """SELECT p_partkey AS id, '/m/' || p_partkey AS filepath, p_name AS title, p_brand AS artist, p_size AS n_hashes FROM part
UNION ALL SELECT max(l_orderkey * 100 + l_linenumber), '/new/' || l_partkey, 'later', 'x', 1 FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY l_partkey"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by order status; what isn't a known source counts as the command line; then statistics by source."""
    runs = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "O", "url").otherwise(F.col("o_orderpriority")).alias("source"), F.col("o_custkey").alias("identified"))
    return library.run_log(runs).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("identified").alias("identified"))


LOG_SQL = "SELECT CASE o_orderstatus WHEN 'F' THEN 'file' WHEN 'O' THEN 'url' ELSE 'cli' END AS source, count(*) AS runs, sum(o_custkey)::BIGINT AS identified FROM orders GROUP BY 1"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).withColumn("kind", F.get(F.array(*map(F.lit, ("library", "acoustid", "tier2", "other"))), (F.col("quantity") % 4).cast("int")))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.accepted(_kinds(spark, sf_dir)).select("mix_id", "ord", "kind", "score")


ACCEPT_SQL = f"""WITH {_LI_SQL}, k AS (SELECT mix_id, ord, ['library', 'acoustid', 'tier2', 'other'][quantity % 4 + 1] AS kind, score FROM n)
SELECT * FROM k WHERE score >= CASE kind WHEN 'library' THEN 0.85 WHEN 'acoustid' THEN 0.8 WHEN 'tier2' THEN 0.85 END"""


def best_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in two lists, by quantity."""
    rows = entries(spark, sf_dir).withColumns({"list_rank": F.col("quantity") % 2, "pos": F.col("ord")})
    return library.best_of_lists(rows, ["mix_id"])


LISTS_SQL = f"""WITH {_LI_SQL}, b AS (SELECT mix_id, arg_max(struct_pack(list_rank := quantity % 2, pos := ord, artist := artist, title := title, score := score), (score, -(quantity % 2), -ord)) AS b FROM n GROUP BY 1)
SELECT mix_id, unnest(b) FROM b"""


def reactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as candidates of two lists, with three window scores each."""
    s = F.col("score")
    rows = entries(spark, sf_dir).withColumns({"list_rank": F.col("quantity") % 2, "pos": F.col("ord"), "scores": F.array(s, s - 0.1, s - F.col("quantity") / 100)})
    return library.reactive(rows.select("mix_id", "list_rank", "pos", "artist", "title", "scores"), "mix_id")


REACTIVE_SQL = f"""WITH {_LI_SQL}, w AS (SELECT mix_id, quantity % 2 AS list_rank, ord AS pos, artist, title, list_sort([score, score - 0.1, score - quantity / 100]) AS s FROM n),
g AS (SELECT *, s[3] AS score FROM w WHERE s[3] >= 0.8 AND s[2] >= 0.65),
b AS (SELECT mix_id, arg_max(struct_pack(list_rank := list_rank, pos := pos, artist := artist, title := title, score := score), (score, -list_rank, -pos)) AS b FROM g GROUP BY 1)
SELECT mix_id, unnest(b) FROM b"""


def reactive_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as transcripts, with two searches of two hits; previews are vectors' hashes, and a turn's variants stretches of
    one of them, the second with a bit changed in each hash, the third of another place."""
    c = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(50)).alias("v"))
    mixed = lambda x: F.pmod(F.floor(x.cast("double") * 65536) * 2654435761, F.lit(4294967296)).cast("long")
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", mixed).alias("h"))
    hit = lambda rank, pos, more: F.struct(F.lit(rank).alias("list_rank"), F.lit(pos).alias("pos"), F.pmod(F.col("v") + more, F.lit(50)).alias("p"))
    hits = c.select("k", F.explode(F.array(hit(0, 0, 1), hit(0, 1, 0), hit(0, 4, 0), hit(1, 0, 0), hit(1, 1, 2))).alias("h")).select("k", "h.list_rank", "h.pos", F.concat(F.lit("a"), "h.p").alias("artist"), F.concat(F.lit("t"), "h.p").alias("title"), F.concat(F.lit("search:"), "h.list_rank").alias("source"), F.concat(F.lit("u:"), "h.p").alias("preview"))
    stretch = F.array(F.slice("h", 9, 24), F.transform(F.slice("h", 9, 24), lambda x: x.bitwiseXOR(F.lit(1))), F.slice("h", 20, 24))
    variants = c.join(vectors, "v").select("k", F.posexplode(stretch).alias("pitch_ord", "hashes"))
    return library.identify_reactive(c, hits, variants, vectors.select(F.concat(F.lit("u:"), "v").alias("preview"), F.col("h").alias("hashes")), "k", "text").select("k", "artist", "title", F.round("score", 9).alias("score"), "source", "preview")


PREVIEWS_SQL = r"""WITH c AS (SELECT conv_id || '-' || turn AS k, (conv_id * 31 + turn) % 50 AS v, trim(regexp_replace(regexp_replace(text, '[\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM conversations),
p AS (SELECT *, list_filter(list_transform(string_split_regex(flat, '[.,!?;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
b AS (SELECT k, v, string_split_regex(coalesce(left(list_sort(list_transform(parts, lambda x, i: struct_pack(n := -length(x), i := i, p := x)))[1].p, 120), flat), '\s+') AS words FROM p),
g AS (SELECT k, v FROM b WHERE len(list_filter(words, lambda w: w <> '')) >= 5 AND len(list_distinct(list_transform(words, lambda w: lower(w)))) >= 4),
e AS (SELECT vec_id AS v, list_transform(embedding, lambda x: ((floor(x::DOUBLE * 65536)::BIGINT * 2654435761 % 4294967296) + 4294967296) % 4294967296) AS h FROM embeddings),
q AS (SELECT k, e.v, unnest([h[9:32], list_transform(h[9:32], lambda x: xor(x, 1)), h[20:43]]) AS q, unnest([0, 1, 2]) AS o FROM g JOIN e USING (v)),
s AS (SELECT k, x.r, x.pos, (q.v + x.m) % 50 AS pv, o, q FROM q, (SELECT unnest([struct_pack(r := 0, pos := 0, m := 1), struct_pack(r := 0, pos := 1, m := 0), struct_pack(r := 1, pos := 0, m := 0), struct_pack(r := 1, pos := 1, m := 2)]) AS x)),
al AS (SELECT k, r, pos, pv, o, off, 1 - list_sum(list_transform(generate_series(1, 24), lambda i: bit_count(xor(q[i], h[off + i])))) / (24 * 32) AS score FROM (SELECT s.*, e.h, unnest(generate_series(0, len(e.h) - 24)) AS off FROM s JOIN e ON e.v = s.pv)),
m AS (SELECT k, r, pos, pv, o, coalesce(arg_min(score, off) FILTER (score > 0.97), max(score)) AS score FROM al GROUP BY ALL),
w AS (SELECT k, r, pos, pv, list_sort(list(score)) AS ss FROM m GROUP BY 1, 2, 3, 4),
ok AS (SELECT *, ss[3] AS score FROM w WHERE ss[3] >= 0.8 AND ss[2] >= 0.65),
f AS (SELECT k, arg_max(struct_pack(r := r, pv := pv, score := score), (score, -r, -pos)) AS b FROM ok GROUP BY k)
SELECT k, 'a' || b.pv AS artist, 't' || b.pv AS title, round(b.score, 9) AS score, 'search:' || b.r AS source, 'u:' || b.pv AS preview FROM f"""


def by_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as transcripts; each has two hits, the first without names where the turn is even and the user's."""
    c = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", "role", "turn")
    named = (F.col("pos") == 1) | (F.col("turn") % 2 == 1) | (F.col("role") != "user")
    hits = c.select("k", F.explode(F.array(F.lit(1), F.lit(0))).alias("pos"), "role", "turn").select("k", "pos", F.when(named, F.col("role")).alias("artist"), F.when(named, F.concat(F.lit("hit "), "pos")).otherwise("").alias("title"))
    return library.by_lyrics(c, hits, "k", "text")


LYRICS_SQL = r"""WITH c AS (SELECT conv_id || '-' || turn AS k, role, turn, trim(regexp_replace(regexp_replace(text, '[\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM conversations),
p AS (SELECT *, list_filter(list_transform(string_split_regex(flat, '[.,!?;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
b AS (SELECT k, role, turn, coalesce(left(list_sort(list_transform(parts, lambda x, i: struct_pack(n := -length(x), i := i, p := x)))[1].p, 120), flat) AS phrase FROM p)
SELECT k, phrase, role AS artist, 'hit 0' AS title, 0.55::DOUBLE AS score, 'lyrics:genius' AS source FROM b WHERE length(phrase) >= 10 AND (turn % 2 = 1 OR role <> 'user')"""


def mirrors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on four platforms, by quantity; the three best for each recording's first title."""
    rows = entries(spark, sf_dir)
    asks = rows.where("ord = 1").select("mix_id", F.concat("title", F.lit(" "), "artist").alias("query"))
    found = rows.select("mix_id", "ord", "title", (F.col("quantity") * 20).cast("double").alias("duration_sec"), (F.col("quantity") % 4).alias("p"))
    parts = [found.where(F.col("p") == k).withColumn("platform", F.lit(name)).drop("p") for k, name in enumerate(("youtube", "soundcloud", "mixcloud", "mixesdb"))]
    return library.mirrors_of(asks, parts, "mix_id", 3).select("mix_id", "rank", "platform", "ord", "title", F.round("score", 6).alias("score"))


MIRRORS_SQL = f"""WITH {_LI_SQL}, q AS (SELECT mix_id, list_distinct(regexp_extract_all(lower(title || ' ' || artist), '[a-z0-9]+')) AS q FROM n WHERE ord = 1),
s AS (SELECT mix_id, ord, title, quantity % 4 AS p, len(list_intersect(q, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')))) / greatest(len(q), 1) * CASE WHEN quantity * 20 < 300 THEN 0.6 ELSE 1.0 END AS score FROM n JOIN q USING (mix_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY score DESC, p, ord) AS rank FROM s)
SELECT mix_id, rank, ['youtube', 'soundcloud', 'mixcloud', 'mixesdb'][p + 1] AS platform, ord, title, round(score, 6) AS score FROM r WHERE rank <= 3"""


def playlist_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands have strict answers for even suppliers, loose ones for every third."""
    asks = catalogue.playlist_requests(entries(spark, sf_dir), "mix_id")
    names = entries(spark, sf_dir).select("artist", "title").distinct().withColumn("n", F.substring("artist", -4, 4).cast("int"))
    hit = lambda search, flag: names.where(flag).select(search.alias("search"), F.concat(F.lit("u:"), "artist").alias("uri"), F.lit(0).alias("pos"))
    hits = hit(F.concat(F.lit("track:"), "title", F.lit(" artist:"), "artist"), "n % 2 = 0").unionByName(hit(F.concat("artist", F.lit(" "), "title"), "n % 3 = 0"))
    return library.playlist_matches(asks, hits, ["mix_id", "ord"])


PLAYLIST_SQL = f"""WITH {_LI_SQL}, k AS (SELECT mix_id, ord, artist, right(artist, 4)::INTEGER AS x FROM n)
SELECT mix_id, ord, CASE WHEN x % 2 = 0 OR x % 3 = 0 THEN 'u:' || artist END AS uri, CASE WHEN x % 2 = 0 THEN 'strict' WHEN x % 3 = 0 THEN 'loose' ELSE 'unmatched' END AS how FROM k"""


def unit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and place units, block signs and last JSON lines of invented logs."""
    log = F.concat(F.lit("start\n"), F.when(F.col("p_size") % 2 == 0, F.lit('{"a": 1}\n')).otherwise(F.lit("")), F.when(F.col("p_size") % 3 == 0, F.lit("ERROR: Sign in to CONFIRM\n")).otherwise(F.lit("")), F.lit(' {"b": '), "p_size", F.lit("}\nend"))
    rows = _t(spark, sf_dir, "part").withColumn("log", log)
    return rows.select("p_partkey", F.round(library.semitones(F.col("p_size") - 25), 9).alias("semitones"), library.offset_seconds("p_size").alias("seconds"), text.block_sign("log").alias("blocked"), extract.last_json_line(F.col("log")).alias("line"))


UNIT_SQL = """SELECT p_partkey, round((p_size - 25) / 100 * 12, 9) AS semitones, p_size / 8.0 AS seconds, p_size % 3 = 0 AS blocked, ' {"b": ' || p_size || '}' AS line FROM part"""


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook variant: gaps capped, segments of over five seconds."""
    rows = day_entries(spark, sf_dir)
    d = durations(rows)
    return timeline.segments(timeline.gap_cap(rows.select("mix_id", F.floor("start_sec").cast("double").alias("t")), d, "mix_id"), d, "mix_id", longer=True, bare=False)


LONG_SQL = f"""WITH {_DAY_SQL}, pts AS (SELECT DISTINCT mix_id, floor(start_sec) AS t, false AS is_end FROM e UNION ALL SELECT DISTINCT mix_id, 86400.0, true FROM e),
gp AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY mix_id ORDER BY t, is_end), 0) AS before FROM pts),
m AS (SELECT mix_id, t, 'orig' AS kind FROM pts WHERE NOT is_end UNION ALL SELECT DISTINCT mix_id, 0, 'start' FROM e
  UNION ALL SELECT mix_id, before + i * 90, 'gap' FROM gp, LATERAL (SELECT unnest(generate_series(1, ceil((t - before) / 90)::BIGINT - 1)) AS i) WHERE t - before > 90),
s AS (SELECT mix_id, t AS start_sec, coalesce(lead(t) OVER (PARTITION BY mix_id ORDER BY t, kind), 86400) AS end_sec, kind AS boundary FROM m),
k AS (SELECT * FROM s WHERE end_sec - start_sec > 5), l AS (SELECT mix_id, max(end_sec) AS last FROM k GROUP BY 1)
SELECT * FROM k UNION ALL SELECT mix_id, last, 86400, 'end' FROM l WHERE last < 86399"""


def loudest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuewright.plans.timeline_queries import framed_rms

    return timeline.loudest_window(framed_rms(spark, sf_dir), "mix_id")


LOUD_SQL = f"""WITH {_DAY_SQL}, i AS (SELECT mix_id, score, row_number() OVER (PARTITION BY mix_id ORDER BY start_sec, ord) - 1 AS i FROM e),
w AS (SELECT mix_id, i, sum(score * score) OVER f AS s2, count(*) OVER f AS n FROM i WINDOW f AS (PARTITION BY mix_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
fr AS (SELECT mix_id, (i // 4)::BIGINT AS frame, round(sqrt(s2 / 16), 6) AS rms FROM w WHERE n = 16 AND i % 4 = 0)
SELECT mix_id, arg_max(frame, (rms, -frame)) AS frame, max(rms) AS rms FROM fr GROUP BY 1"""


def resolve_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days end to end: views, clicks and errors are segments; purchases and sign-ups listed entries, some of these without place. Up to four
    library candidates, two of a sampled matcher and a lyrics hit, picks for some segments and stem matches for some unknowns."""
    rows = day_results(spark, sf_dir)
    events = day_entries(spark, sf_dir).select("mix_id", "ord", "artist", "score")
    late = F.col("source").eqNullSafe("signup") & (F.col("ord") % 4 == 0)
    listed = day_entries(spark, sf_dir).where("source in ('purchase', 'signup')").withColumns({"title": F.when(late & (F.col("ord") % 16 > 0), F.concat(F.lit("extra "), F.col("ord") % 8)).otherwise(F.col("title")), "start_sec": F.when(~late, F.col("start_sec"))})

    def offers(source: str, *hits: tuple[str, str, str]) -> resolution.Stage:
        """Hits (condition, addition to the artist's name, score), in their order."""
        made = F.array(*[F.struct(F.lit(i).alias("pick_rank"), F.expr(there).alias("there"), F.concat("artist", F.lit(more)).alias("artist"), F.expr(score).cast("double").alias("score")) for i, (there, more, score) in enumerate(hits)])
        known = events.select("mix_id", "ord", F.explode(made).alias("h")).where("h.there").select("mix_id", "ord", "h.*")
        return resolution.Stage(source, lambda open_: open_.join(known, ["mix_id", "ord"]).select("mix_id", "ord", "pick_rank", "artist", F.concat(F.lit("on "), "artist").alias("title"), "score", F.lit(source).alias("source")), 3 if source == "library" else 1)

    stages = [
        offers("library", ("ord % 3 > 0", "", "score"), ("ord % 3 > 0", " ii", "score * 0.9"), ("ord % 6 = 2", " iii", "score * 0.8"), ("ord % 6 = 2", " iv", "1")),
        offers("shazam", ("ord % 2 = 0", "", "least(1D, score + 0.1)"), ("ord % 2 = 0", " live", "1")),
        offers("lyrics:genius", ("ord % 5 = 0", " words", "0.55")),
    ]
    picks = lambda pools: pools.select("mix_id", "ord").distinct().where("ord % 7 = 0 or ord % 11 = 0 or ord % 13 = 0").withColumn("candidate_index", F.expr("CASE WHEN ord % 7 = 0 THEN 1 WHEN ord % 13 = 0 THEN -1 END"))
    stems = lambda asked: asked.join(events, ["mix_id", "ord"]).where("ord % 4 = 0").select("mix_id", "ord", F.lit(0).alias("stem"), "artist", F.concat(F.lit("on "), "artist").alias("title"), F.when(F.col("ord") % 8 == 0, 0.4).otherwise(0.7).alias("score"))
    segments = rows.where("source in ('view', 'click', 'error')")
    return resolution.resolve(listed, segments, stages, durations(rows), "mix_id", picks=picks, stems=stems, longest_gap=900.0, bracket=1800.0)


_RUN_PARTS_SQL = f"""{_DAY_SQL},
d AS (SELECT DISTINCT mix_id FROM e),
li0 AS (SELECT * REPLACE (CASE WHEN late AND ord % 16 > 0 THEN 'extra ' || ord % 8 ELSE title END AS title, CASE WHEN NOT late THEN start_sec END AS start_sec) FROM (SELECT *, source = 'signup' AND ord % 4 = 0 AS late FROM e WHERE source IN ('purchase', 'signup'))),
li AS (SELECT *, start_sec - lag(start_sec, 1, 0.0) OVER (PARTITION BY mix_id ORDER BY start_sec, ord) AS gap FROM li0 WHERE NOT late),
sure AS (SELECT mix_id FROM li GROUP BY 1 HAVING max(start_sec) / 86400 >= 0.8 AND count(*) / 1440 >= 1.0 / 3 AND greatest(max(gap), 86400 - max(start_sec)) <= 300),
promoted AS (SELECT mix_id, coalesce(start_sec, 0) AS start_sec, coalesce(lead(start_sec) OVER (PARTITION BY mix_id ORDER BY ord), coalesce(start_sec, 0) + 60) AS end_sec, artist, title, 1.0::DOUBLE AS score, source, 1::BIGINT AS n_merged FROM li0 WHERE mix_id IN (SELECT mix_id FROM sure)),
sg AS MATERIALIZED (SELECT mix_id, ord, start_sec, end_sec, artist, score AS s, ord % 3 > 0 AS a, ord % 2 = 0 AND (ord % 3 = 0 OR score < 0.85) AS b,
  ord % 5 = 0 AND greatest(CASE WHEN ord % 3 > 0 THEN score ELSE 0 END, CASE WHEN ord % 2 = 0 AND (ord % 3 = 0 OR score < 0.85) THEN least(1.0, score + 0.1) ELSE 0 END) < 0.85 AS c
  FROM r WHERE source IN ('view', 'click', 'error') AND mix_id NOT IN (SELECT mix_id FROM sure)),
ca AS (SELECT mix_id, ord, unnest([struct_pack(p := a, k := 0, n := artist, s := s, c := 'library'), struct_pack(p := a, k := 1, n := artist || ' ii', s := s * 0.9::DOUBLE, c := 'library'), struct_pack(p := ord % 6 = 2, k := 2, n := artist || ' iii', s := s * 0.8::DOUBLE, c := 'library'),
  struct_pack(p := b, k := 3, n := artist, s := least(1.0, s + 0.1), c := 'shazam'), struct_pack(p := c, k := 4, n := artist || ' words', s := 0.55::DOUBLE, c := 'lyrics:genius')]) AS x FROM sg),
po AS MATERIALIZED (SELECT mix_id, ord, x.n AS artist, x.s AS score, x.c AS source, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY mix_id, ord) AS n FROM ca WHERE x.p WINDOW w AS (PARTITION BY mix_id, ord ORDER BY x.k)),
pk AS (SELECT *, ord % 7 = 0 OR ord % 11 = 0 OR ord % 13 = 0 AS picked, CASE WHEN ord % 7 = 0 THEN 1 WHEN ord % 13 = 0 THEN n - 1 END AS want FROM (SELECT *, max(n) OVER (PARTITION BY mix_id) > 1 AS many FROM po)),
ch AS (SELECT mix_id, ord, artist, score, source FROM pk WHERE many AND picked AND i = want
  UNION ALL SELECT mix_id, ord, arg_max(artist, (score, -i)), max(score), arg_max(source, (score, -i)) FROM pk WHERE NOT (many AND picked) GROUP BY 1, 2 HAVING max(score) >= 0.5),
fa AS MATERIALIZED (SELECT sg.mix_id, sg.ord, start_sec, end_sec, sg.artist AS own, ch.artist, ch.score, ch.source, po.ord IS NOT NULL AS late FROM sg LEFT JOIN ch USING (mix_id, ord) LEFT JOIN (SELECT DISTINCT mix_id, ord FROM po) po USING (mix_id, ord)),
dp AS (SELECT mix_id FROM fa GROUP BY 1 HAVING count(*) FILTER (source IS NULL) / (count(*) FILTER (late) + count(*) FILTER (source IS NULL)) > 0.5 OR count(*) FILTER (source IS NULL) >= 3),
tr_ AS (SELECT *, mix_id IN (SELECT mix_id FROM dp) AND row_number() OVER (PARTITION BY mix_id ORDER BY start_sec - end_sec, late, ord) <= 20 AND end_sec - start_sec >= 8 AND ord % 4 = 0 AS ok FROM fa WHERE source IS NULL),
q AS MATERIALIZED (SELECT mix_id, ord, start_sec, end_sec, artist, 'on ' || artist AS title, score, source FROM fa WHERE source IS NOT NULL
  UNION ALL SELECT mix_id, ord, start_sec, end_sec, own, 'on ' || own, 0.7::DOUBLE, 'shazam+demucs' FROM tr_ WHERE ok AND ord % 8 > 0
  UNION ALL SELECT mix_id, ord, start_sec, end_sec, NULL, NULL, NULL, 'error' FROM tr_ WHERE NOT ok),
{_SMOOTH_CTE.format(most=900).replace('FROM r ', 'FROM q ')},
both_ AS (SELECT mix_id, ord, start_sec, end_sec, artist, title, score, source FROM q WHERE source <> 'error' UNION ALL SELECT mix_id, uord, us, ue, bef.a, 'on ' || bef.a, least(bef.s, aft.s), 'smoothed:' || bef.c FROM s WHERE fills), {_RUNS_SQL.format(rows='both_')},
{_OVERLAY_SQL.replace("(SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY ord) AS k FROM r WHERE source = 'view')", '(SELECT *, run AS k FROM runs)')
    .replace("FROM e WHERE source IN ('purchase', 'signup')", "FROM li WHERE mix_id NOT IN (SELECT mix_id FROM sure)").replace('false) ORDER BY k)', 'false, n := n_merged) ORDER BY k)')
    .replace('c := true)])', 'c := true, n := 1::BIGINT)])').replace('c := true) ELSE y', 'c := true, n := y.n) ELSE y').replace('c := false)) END', 'c := false, n := 1::BIGINT)) END').replace('1::BIGINT AS n_merged FROM nx', 'x.n AS n_merged FROM nx')},
tl AS (SELECT DISTINCT mix_id, artist, title, source FROM li0 WHERE late AND mix_id NOT IN (SELECT mix_id FROM sure) AND NOT EXISTS (SELECT 1 FROM ends WHERE ends.mix_id = li0.mix_id AND ends.artist = li0.artist AND ends.title = li0.title)),
un AS (SELECT mix_id, uord AS ord, us, ue, (us + ue) / 2 AS m FROM s WHERE NOT fills),
br AS (SELECT un.mix_id, un.ord, max(l.start_sec) FILTER (l.start_sec <= m) AS lo, min(l.start_sec) FILTER (l.start_sec >= m) AS hi FROM un JOIN li l ON l.mix_id = un.mix_id GROUP BY 1, 2),
al AS (SELECT * FROM promoted UNION ALL SELECT * FROM ends UNION ALL SELECT mix_id, 86399, 86400, artist, title, 1, source, 1 FROM tl
  UNION ALL SELECT un.mix_id, us, ue, NULL, NULL, NULL, 'unknown', 0 FROM un LEFT JOIN br USING (mix_id, ord) WHERE NOT coalesce(hi - lo <= 1800, false)),
fin AS (SELECT mix_id, row_number() OVER (PARTITION BY mix_id ORDER BY start_sec, end_sec, source, artist NULLS FIRST, title NULLS FIRST, score NULLS FIRST)::INTEGER AS ord, start_sec, end_sec, artist, title, score, source, n_merged FROM al)"""
RESOLVE_SQL = f"WITH {_RUN_PARTS_SQL} SELECT * FROM fin"


def resolve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution's rows as a plain list a day."""
    rows = resolve_whole(spark, sf_dir)
    return render.text_list(rows.where("source <> 'unknown'"), rows.where("source = 'unknown'"), "mix_id")


TEXT_SQL = f"""WITH {_RUN_PARTS_SQL}, lns AS (SELECT mix_id, start_sec, ord, source = 'unknown' AS kind, floor(start_sec)::BIGINT AS t,
  CASE WHEN source = 'unknown' THEN '[unidentified]' ELSE artist || ' - ' || title || printf(' (%.2f)', round(score, 2)) END AS body FROM fin)
SELECT mix_id, string_agg(CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%02d:%02d', t // 60, t % 60) END || '  ' || body, chr(10) ORDER BY start_sec, kind, ord) AS text FROM lns GROUP BY mix_id"""

def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of recordings written in all forms and read back: tracks and unknown stretches."""
    path = Tables(spark, "results").folder
    rows = entries(spark, sf_dir).withColumns({"end_sec": F.col("start_sec") + 200, "source": F.lit("library"), "n_merged": F.lit(1).cast("long"), "filepath": F.lit("/m")})
    render.write_results(rows.where("ord % 4 <> 0"), rows.where("ord % 4 = 0").select("mix_id", "ord", "start_sec", "end_sec"), "mix_id", path)
    tracks, unknown = render.read_results(spark, f"{path}/json")
    no = F.lit(None).cast("string")
    return tracks.select("source_input", "ord", "start_sec", "end_sec", "artist", "title", "score").unionByName(unknown.select("source_input", "ord", "start_sec", "end_sec", no.alias("artist"), no.alias("title"), no.cast("double").alias("score")))


FILES_SQL = f"""WITH {_LI_SQL} SELECT mix_id::VARCHAR AS source_input, (row_number() OVER (PARTITION BY mix_id, ord % 4 = 0 ORDER BY ord) - 1)::INTEGER AS ord, start_sec, start_sec + 200 AS end_sec,
  CASE WHEN ord % 4 <> 0 THEN artist END AS artist, CASE WHEN ord % 4 <> 0 THEN title END AS title, CASE WHEN ord % 4 <> 0 THEN round(score, 3) END AS score FROM n"""


def recorded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recorded search answers by brand, 25 places a page, some of them left out; brands of a one have an empty second page. The first
    60 of each brand are read by the data source."""
    folder = Tables(spark, "answers").folder
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    part = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size", rank.alias("r"))
    there = (F.col("p_size") % 5 > 0) & ~(F.col("p_brand").endswith("1") & (F.floor(F.col("r") / 25) == 1))
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.concat(F.lit("artist "), "p_size").alias("name")).alias("artist"))
    pages = part.groupBy(F.col("p_brand").alias("query"), (F.floor(F.col("r") / 25) * 25).cast("int").alias("index")).agg(F.array_sort(F.collect_list(F.when(there, F.struct("r", item.alias("i"))))).alias("x"))
    blocks = pages.withColumn("block", F.floor(F.col("index") / (answers.PAGE * answers.BLOCK)).cast("int")).repartition("query", "block").sortWithinPartitions("query", "block", "index")
    blocks.select(F.to_json(F.struct("index", F.transform("x", lambda x: x["i"]).alias("data"))).alias("value"), "query", "block").write.partitionBy("query", "block").text(folder)
    answers.register(spark)
    return spark.read.format(answers.FORMAT).option("path", folder.removeprefix("file:")).option("limit", 60).load().select("query", "index", "pos", "id", "title", "artist")


PAGES_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part),
i AS (SELECT *, (r // 25 * 25)::INTEGER AS "index", (row_number() OVER (PARTITION BY p_brand, r // 25 ORDER BY r) - 1)::INTEGER AS pos FROM r WHERE p_size % 5 > 0 AND NOT (p_brand LIKE '%1' AND r // 25 = 1)),
g AS (SELECT p_brand, r // 25 AS k, count(*) FILTER (p_size % 5 > 0 AND NOT (p_brand LIKE '%1' AND r // 25 = 1)) AS n FROM r GROUP BY 1, 2),
e AS (SELECT p_brand, coalesce(min(k) FILTER (n = 0), 1000000000) AS stop FROM g GROUP BY 1),
f AS (SELECT i.*, row_number() OVER (PARTITION BY p_brand ORDER BY r) AS nth FROM i JOIN e USING (p_brand) WHERE r // 25 < stop)
SELECT p_brand AS query, "index", pos, p_partkey AS id, p_name AS title, 'artist ' || p_size AS artist FROM f WHERE nth <= 60"""


def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, four times as loud and so clipped here and there, as WAV files of 16 bits, decoded in chunks of three hundredths of a second."""
    rows = _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("/v/"), "vec_id").alias("path"), F.transform("embedding", lambda x: x.cast("double") * 4).alias("x"))
    files = rows.select("path", signal.encode_wav("x", 1_000).alias("content"))
    return audio.wav_chunks(files, 1_000, 0.03).select("path", "chunk_no", F.posexplode("samples").alias("pos", "x"))


WAV_SQL = """WITH s AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT '/v/' || vec_id AS path, (i // 30)::INTEGER AS chunk_no, (i % 30)::INTEGER AS pos, trunc(greatest(least(x::DOUBLE * 4, 1), -1) * 32767) / 32768 AS x FROM s"""


def music_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue whose paths end in many ways, some blank; null names are empty (A2)."""
    ends = F.get(F.array(*map(F.lit, (".mp3", ".FLAC", ".vdjsample", "", ".m4a", ".txt"))), (F.col("p_partkey") % 6).cast("int"))
    rows = _t(spark, sf_dir, "part").select(F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.concat(F.lit("/m/a.b/"), "p_partkey", ends)).alias("filepath"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"))
    return audio.catalogue(rows)


MUSIC_SQL = """SELECT '/m/a.b/' || p_partkey || ['.mp3', '.FLAC', '', '', '.m4a', ''][p_partkey % 6 + 1] AS filepath, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS title, p_brand AS artist
FROM part WHERE p_size % 9 <> 0 AND p_partkey % 6 IN (0, 1, 4)"""


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (chart_tracks, CHART_SQL), (artist_union, UNION_SQL), (typed_library, TYPED_SQL), (library_build, BUILD_SQL), (library_size, SIZE_SQL), (run_log, LOG_SQL), (accepted, ACCEPT_SQL), (best_of_lists, LISTS_SQL), (reactive, REACTIVE_SQL), (by_lyrics, LYRICS_SQL), (reactive_previews, PREVIEWS_SQL),
        (mirrors_of, MIRRORS_SQL), (playlist_matches, PLAYLIST_SQL), (unit_functions, UNIT_SQL), (long_segments, LONG_SQL), (loudest_window, LOUD_SQL), (resolve_whole, RESOLVE_SQL), (resolve_text, TEXT_SQL), (result_files, FILES_SQL), (recorded_pages, PAGES_SQL), (music_catalogue, MUSIC_SQL), (wav_samples, WAV_SQL),
    )
}
