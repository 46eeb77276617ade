"""Library tables, chart rows, run logs and given-candidate composites (inventory A4, A5, A8, B9, C7, C8, C10, E11, G5, G10, K1, K2, K5, K6,
K10, M5-M7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import clean_phrase, phrase_passes
from cuewright.operators.catalogue import ranked_mirrors
from cuewright.operators.matching import upper_median_gate
from cuewright.operators.similarity import variant_scores
from cuewright.sources.audio import audio_files

# Scores from which a match of each kind counts.
FLOORS = {"library": 0.85, "acoustid": 0.80, "greedy": 0.5, "tier2": 0.85}
LYRICS_SCORE, LEAST_PHRASE = 0.55, 10
RUN_SOURCES = ("file", "url", "cli")


def chart_tracks(answers: DataFrame, answer: str, key: str, limit: int) -> DataFrame:
    """(key, pos, id, uri, artist, title, album, preview) of chart answers (A5), at most ``limit`` an answer; tracks without preview or
    identifier are left out (E11)."""
    kind = "struct<data:array<struct<id:long,title:string,preview:string,artist:struct<name:string>,album:struct<title:string>>>>"
    rows = answers.select(key, F.posexplode(F.slice(F.from_json(F.col(answer), kind)["data"], 1, limit)).alias("pos", "t")).where("t.id is not null and t.preview is not null and t.preview <> ''")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        key, "pos", "t.id", F.concat(F.lit("deezer:"), F.col("t.id").cast("string")).alias("uri"), text(F.col("t.artist.name")).alias("artist"), text(F.col("t.title")).alias("title"),
        text(F.col("t.album.title")).alias("album"), F.col("t.preview").alias("preview"),
    )


def artist_union(requests: DataFrame, artists: str, key: str) -> DataFrame:
    """(key, pos, artist): the names in a comma list, trimmed, empty ones left out."""
    rows = requests.select(key, F.posexplode(F.split(F.col(artists), ",")).alias("pos", "artist"))
    return rows.withColumn("artist", F.trim("artist")).where("artist <> ''")


def library_source(spark: SparkSession, folder: str, table: str | None = None, source: str | None = None) -> DataFrame:
    """Where a library's rows come from (A4): what ``source`` names, else the catalogue table if there is one, else the folder's music."""
    kind = source or ("table" if table else "folder")
    if kind not in ("table", "folder") or (kind == "table" and not table):
        raise ValueError(f"no library source {kind!r}")
    return spark.read.parquet(table) if kind == "table" else audio_files(spark, folder)


def library_size(library: DataFrame) -> DataFrame:
    """(tracks) in a library."""
    return library.agg(F.count(F.lit(1)).alias("tracks"))


def run_log(runs: DataFrame, source: str = "source") -> DataFrame:
    """Run rows whose source is one of the known ones, others being ``cli``."""
    return runs.withColumn(source, F.when(F.col(source).isin(*RUN_SOURCES), F.col(source)).otherwise("cli"))


def route_unknowns(segments: DataFrame, picks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(segments with their pick's names, segments without one) (C7): no candidate, or none that was picked."""
    known = segments.join(picks.select(*key, "artist", "title", "score", "source"), key)
    return known, segments.join(picks.select(*key), key, "left_anti")


def accepted(matches: DataFrame, floors: dict[str, float] = FLOORS, kind: str = "kind") -> DataFrame:
    """Matches whose score reaches the floor of their kind; kinds without floor go."""
    table = F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])
    return matches.where(F.col("score") >= F.try_element_at(table, kind))


def best_of_lists(candidates: DataFrame, key: list[str], rank: str = "list_rank", pos: str = "pos") -> DataFrame:
    """The best candidate of each key over ordered lists: a later one must be strictly better."""
    best = F.max_by(F.struct(rank, pos, "artist", "title", "score"), F.struct("score", -F.col(rank), -F.col(pos)))
    return candidates.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def reactive(candidates: DataFrame, key: str) -> DataFrame:
    """Reactive identification over given candidates (M6): of those whose window scores (``scores``, an array) have a best of 0.80 and
    an upper median of 0.65 or more, the best."""
    one = [key, "list_rank", "pos"]
    gate = upper_median_gate(candidates.select(*one, F.explode("scores").alias("score")), one)
    return best_of_lists(candidates.join(gate, one).withColumn("score", F.col("best")), [key])


def identify_reactive(transcripts: DataFrame, hits: DataFrame, variants: DataFrame, previews: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """Reactive identification from phrase to verified preview (M6): (key, phrase, artist, title, score, source, preview).

    A transcript's phrase (C10) that passes its gate (C9) takes the first ``most`` hits of each search (key, list_rank, pos, artist, title, source,
    preview); the key's pitch ``variants`` (key, pitch_ord, hashes) are aligned with each preview's hashes (H4), and of those whose scores
    pass the gates (G4) the best stays (G5). Previews without hashes and keys without variants have no result.
    """
    phrases = transcripts.select(key, clean_phrase(text).alias("phrase")).where(phrase_passes("phrase"))
    asked = hits.where((F.col("pos") < most) & F.col("preview").isNotNull()).join(phrases, key)
    known = previews.select("preview", F.col("hashes").alias("own")).where(F.size("own") > 0)
    wanted = variants.where(F.col("hashes").isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pitch_ord", "hashes"))), lambda v: v["hashes"]).alias("variants"))
    scored = variant_scores(asked.join(known, "preview").join(wanted, key), "variants", "own", "scores").drop("variants", "own")
    best = reactive(scored.select(key, "list_rank", "pos", "artist", "title", "scores"), key)
    return best.join(scored.select(key, "list_rank", "pos", "phrase", "source", "preview"), [key, "list_rank", "pos"]).select(key, "phrase", "artist", "title", "score", "source", "preview")


def by_lyrics(transcripts: DataFrame, hits: DataFrame, key: str, text: str) -> DataFrame:
    """Lyrics identification over given hits (M7): a transcript's phrase of ten characters or more (C10) takes its first hit, at a fixed
    score. A first hit without artist and title is none (E9)."""
    phrases = transcripts.select(key, clean_phrase(text).alias("phrase")).where(F.length("phrase") >= LEAST_PHRASE)
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    first = hits.groupBy(key).agg(F.min_by(F.struct(name("artist"), name("title")), "pos").alias("h")).where("h.artist <> '' or h.title <> ''")
    return phrases.join(first, key).select(key, "phrase", "h.artist", "h.title", F.lit(LYRICS_SCORE).alias("score"), F.lit("lyrics:genius").alias("source"))


def mirrors_of(queries: DataFrame, platforms: list[DataFrame], key: str, n: int) -> DataFrame:
    """The ``n`` best mirrors over all platforms' candidates (key, ord, platform, title, duration_sec) (M5); ties keep the platforms' order."""
    ranked = [p.withColumn("ord", F.struct(F.lit(i).alias("p"), F.col("ord").cast("long").alias("o"))) for i, p in enumerate(platforms)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    return ranked_mirrors(queries, rows, key).where(F.col("rank") <= n).withColumn("ord", F.col("ord.o"))


def playlist_matches(requests: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """Requests with the address that the strict search has, else the loose one (B9); null: unmatched."""
    found = hits.groupBy("search").agg(F.min_by("uri", "pos").alias("uri"))
    side = lambda c: found.select(F.col("search").alias(c), F.col("uri").alias(f"{c}_uri"))
    rows = requests.join(side("strict"), "strict", "left").join(side("loose"), "loose", "left")
    return rows.select(*key, F.coalesce("strict_uri", "loose_uri").alias("uri"), F.when(F.col("strict_uri").isNotNull(), "strict").when(F.col("loose_uri").isNotNull(), "loose").otherwise("unmatched").alias("how"))


def semitones(percent: str | Column) -> Column:
    """A pitch change in percent as semitones (D-15)."""
    return (F.col(percent) if isinstance(percent, str) else percent) / 100 * 12


def offset_seconds(offset: str | Column, per_second: float = 8.0) -> Column:
    """A place in hashes as seconds (D-16)."""
    return (F.col(offset) if isinstance(offset, str) else offset) / per_second
