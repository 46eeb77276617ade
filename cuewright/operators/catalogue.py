"""Search answers, mirrors, prompts, playlists and jobs as tables (inventory A, B9, C1, C13, D-10, D-19, D-20, E12, L1, M3, M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import once, strip, word_set
from cuewright.operators.matching import duration_factor


def title_artist(tags: Column) -> Column:
    """struct(title, artist, query) of a page's meta tags, array(struct(name, content)), the last of a name counting (D-10); null
    without title. The artist comes from a musician that isn't an artist link, from ``title by artist``, or from the description."""

    def last(name: str) -> Column:
        return F.nullif(F.try_element_at(F.filter(tags, lambda t: t["name"] == name), F.lit(-1))["content"], F.lit(""))

    title = F.coalesce(last("og:title"), last("twitter:title"), F.lit(""))
    musician = F.coalesce(last("music:musician"), last("music:musician:name"), F.lit(""))
    named = F.when(musician.rlike(r"/artist/[^/]+/?[^?]*"), F.lit("")).otherwise(strip(F.replace(F.element_at(F.split(musician, "/"), -1), F.lit("-"), F.lit(" "))))
    by = F.split(title, r"(?iU)\s+by\s+", 2)
    splits = (named == "") & F.lower(title).contains(" by ") & (F.size(by) == 2)
    artist = F.when(splits, strip(F.get(by, F.lit(1)))).otherwise(named)
    title = F.when(splits, strip(F.get(by, F.lit(0)))).otherwise(title)
    bits = F.transform(F.split(F.coalesce(last("og:description"), F.lit("")), "·"), strip)
    artist = F.when((artist == "") & (F.size(bits) >= 2), F.get(bits, F.lit(0))).otherwise(artist)
    return F.when(title != "", F.struct(title.alias("title"), artist.alias("artist"), strip(F.concat(title, F.lit(" "), artist)).alias("query")))


def opensearch_hits(answers: DataFrame, answer: str, key: str) -> DataFrame:
    """(key, pos, title, url) of opensearch answers ``[query, [titles], [.], [urls]]``."""
    part = lambda lists, i: F.from_json(F.get(lists, F.lit(i)), "array<string>")
    both = once(F.from_json(F.col(answer), "array<string>"), lambda lists: F.struct(part(lists, 1).alias("title"), part(lists, 3).alias("url")))
    hits = once(both, lambda b: F.arrays_zip(b["title"].alias("title"), b["url"].alias("url")))
    return answers.select(key, F.posexplode(hits).alias("pos", "h")).select(key, "pos", F.col("h.title").alias("title"), F.col("h.url").alias("url")).where("title is not null and url is not null")


def preview_hits(answers: DataFrame, answer: str, key: str, source: str) -> DataFrame:
    """(key, pos, artist, title, preview, source) of song search answers, those without preview left out."""
    kind = "struct<results:array<struct<artistName:string,trackName:string,previewUrl:string>>,data:array<struct<title:string,preview:string,artist:struct<name:string>>>>"
    first = lambda r: F.transform(r["results"], lambda x: F.struct(x["artistName"].alias("artist"), x["trackName"].alias("title"), x["previewUrl"].alias("preview")))
    second = lambda r: F.transform(r["data"], lambda x: F.struct(x["artist"]["name"].alias("artist"), x["title"].alias("title"), x["preview"].alias("preview")))
    hits = once(F.from_json(F.col(answer), kind), lambda r: F.coalesce(first(r), second(r)))
    rows = answers.select(key, F.posexplode(hits).alias("pos", "h")).where("h.preview is not null and h.preview <> ''")
    return rows.select(key, "pos", F.coalesce("h.artist", F.lit("")).alias("artist"), F.coalesce("h.title", F.lit("")).alias("title"), F.col("h.preview").alias("preview"), F.lit(source).alias("source"))


def json_lines(answers: DataFrame, answer: str, key: str, platform: str) -> DataFrame:
    """Candidates in JSON-lines answers (A22, E12): bad lines and rows without address are skipped; a bare video id becomes a full
    address on YouTube."""
    kind = "struct<id:string,url:string,webpage_url:string,title:string,duration:double>"
    one = lambda line: F.when(F.trim(line) != "", F.from_json(line, kind))
    rows = answers.select(key, F.posexplode(F.transform(F.split(F.col(answer), r"\r?\n"), one)).alias("pos", "r"))
    rows = rows.withColumn("url", F.coalesce(F.nullif("r.webpage_url", F.lit("")), F.col("r.url"), F.lit("")))
    if platform == "youtube":
        bare = F.when(F.col("url") == "", F.coalesce("r.id", F.lit(""))).otherwise(F.col("url"))
        rows = rows.withColumn("url", F.when((bare != "") & ~bare.startswith("http"), F.concat(F.lit("https://www.youtube.com/watch?v="), bare)).otherwise(bare))
    return rows.where("url <> ''").select(key, "pos", F.lit(platform).alias("platform"), "url", F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.duration").alias("duration_sec"))


def next_data(pages: DataFrame, page: str, key: str, paths: tuple[str, ...], most: int) -> DataFrame:
    """(key, pos, title, url) of a page's embedded JSON, by the first path that has a list."""
    body = F.regexp_extract(F.col(page), r"(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1)
    found = F.coalesce(*[F.from_json(F.get_json_object(body, p), "array<struct<title:string,url:string>>") for p in paths])
    return pages.select(key, F.posexplode(F.slice(found, 1, most)).alias("pos", "h")).select(key, "pos", "h.title", "h.url")


def ranked_mirrors(queries: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates of each query by shared words, short ones counting less (M4, M5, I5); ties keep their order."""
    rows = candidates.join(queries.select(key, word_set("query").alias("q")), key).withColumn("t", word_set("title"))
    share = F.when((F.size("q") == 0) | (F.size("t") == 0), 0.0).otherwise(F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1)))
    rows = rows.withColumn("score", duration_factor(share, F.col("duration_sec"))).drop("q", "t")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord")))


def as_candidates(matches: DataFrame, source: str, *keys: str) -> DataFrame:
    """Uniform candidates (C1): null names empty, everything else of a match in ``extra``."""
    extra = [c for c in matches.columns if c not in {*keys, "artist", "title", "score"}]
    pairs = [v for c in extra for v in (F.lit(c), F.col(c).cast("string"))]
    return matches.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("artist", "title")], "score", F.lit(source).alias("source"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("extra"))


def prompts(pools: DataFrame, mix: str, segment: str) -> DataFrame:
    """The text that asks a model to pick (D-20): a block per segment, an indexed line per candidate."""
    line = F.format_string("  [%d] %s - %s (score %.2f, %s)", "candidate_index", "artist", "title", "score", "source")
    blocks = pools.groupBy(mix, segment).agg(F.array_sort(F.collect_list(F.struct("candidate_index", line.alias("line")))).alias("x"))
    block = F.concat(F.format_string("Segment %d:\n", segment), F.array_join(F.transform("x", lambda e: e["line"]), "\n"))
    text = blocks.groupBy(mix).agg(F.array_sort(F.collect_list(F.struct(F.col(segment).alias("s"), block.alias("b")))).alias("y"))
    return text.select(mix, F.array_join(F.transform("y", lambda e: e["b"]), "\n\n").alias("prompt"))


def playlist_requests(tracks: DataFrame, key: str, chunk: int = 100) -> DataFrame:
    """(key, ord, chunk_no, strict, loose) search texts of a playlist's tracks, in chunks (B9, D-19)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_sec", "ord"))
    return tracks.select(
        key, "ord", F.floor((n - 1) / chunk).cast("int").alias("chunk_no"), F.concat(F.lit("track:"), "title", F.lit(" artist:"), "artist").alias("strict"), F.concat("artist", F.lit(" "), "title").alias("loose")
    )


def union_sources(timed: list[DataFrame], untimed: list[DataFrame], late: list[DataFrame], key: str) -> DataFrame:
    """All listed entries of a recording in the order of their sources (L1); untimed ones only where no timed ones are."""
    ranked = [f.withColumn("src_rank", F.lit(i)) for i, f in enumerate([*timed, *untimed, *late])]
    have = ranked[0]
    for f in ranked[1 : len(timed)]:
        have = have.unionByName(f)
    out = have
    for i, f in enumerate(ranked[len(timed) :]):
        out = out.unionByName(f.join(have.select(key).distinct(), key, "left_anti") if i < len(untimed) else f)
    return out


def stem_retry(unknowns: DataFrame, matches: DataFrame, key: str, least: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(rescued, unknowns left) (M3): unknowns marked ``retry`` of ``least`` seconds or more take the first match of their stems;
    those left are the deferred ones, then the failures."""
    first = matches.groupBy(key, "ord").agg(F.min_by(F.struct("artist", "title", "score"), "stem").alias("m"))
    tried = unknowns.join(first, [key, "ord"], "left").withColumn("ok", F.col("retry") & F.col("m").isNotNull() & (F.col("end_sec") - F.col("start_sec") >= least))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    rescued = tried.where("ok").select(key, (-rank).alias("segment_index"), "ord", "start_sec", "end_sec", "m.artist", "m.title", "m.score", F.lit("shazam+demucs").alias("source"))
    left = tried.where("not ok").withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("retry", "ord")))
    return rescued, left.select(key, "pos", "ord", "start_sec", "end_sec")


def job_stats(jobs: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Per job (G7, G9, C13): identified tracks, distinct sources, duration (the last end, else the running time) and the
    three-valued deep-scan flag."""
    t = tracks.groupBy(key).agg(F.count(F.lit(1)).alias("identified"), F.count_distinct("source").alias("sources"), F.max("end_sec").alias("last"))
    flag = F.lower(F.trim(F.coalesce("with_demucs", F.lit(""))))
    deep = F.when(flag.isin("true", "1", "yes", "on"), True).when(flag.isin("false", "0", "no", "off"), False)
    return jobs.join(t, key, "left").select(key, F.coalesce("identified", F.lit(0)).alias("identified"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("last", "running_sec").alias("duration"), deep.alias("deep_scan"))


def untimed_tail(untimed: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Untimed entries as tracks at one place, a second before the end (N1, rule 5)."""
    start = F.greatest(F.lit(0.0), F.col("duration") - 1)
    return untimed.join(durations, key).select(key, start.alias("start_sec"), F.col("duration").alias("end_sec"), "artist", "title", F.lit(1.0).alias("score"), "source", F.lit(1).cast("long").alias("n_merged"))
