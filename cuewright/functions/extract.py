"""Rows out of text, JSON, wiki markup and HTML (inventory 2.E)."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import clock_seconds, once, same_key, split_name, strip

# The line patterns that results depend on, with numbered groups.
TIMED_LINE = r"^\s*(?:\d+\s*[.\)]\s*)?\[?((?:\d{1,2}:)?\d{1,2}:\d{2})\]?\s*[-–—]?\s*(.+?)\s*$"
UNTIMED_LINE = r"^\s*(?:\d+\s*[.\)]\s*|[-•*]\s+)([^-–—|]+?\s+[-–—|]\s+.+)\s*$"
LIST_KEYWORD = r"(?i)\b(tracklist|track\s*list|songs?\s*played|tracklisting)\b"
GENERIC_CHAPTER = (
    r"(?i)^\s*(intro|outro|id|id\s*[-–—]\s*id|outro\s*/\s*id|tracklist|track\s*list|interlude|skit|mix|start|end|warm[\s-]*up|drop|break|"
    r"transition|thanks?( for watching)?|subscribe|like\s*&?\s*subscribe)\s*$"
)
TRACK_NUMBER = r"^\s*\d{1,3}\s*[.\)\-–—]\s*"
WIKI_TRACK = r"^#+\s*(?:\d+\s*[.\)]?\s*)?(?:\[\[)?([^\]\|\-–—]+?)(?:\]\])?\s*[-–—]\s*(?:\[\[)?([^\]\|]+?)(?:\]\])?\s*$"
WIKI_HEADING = r"(?i)^==\s*(tracklist|track ?list)\s*=="
CUE_CLASSES = ("cueValueField", "cueValue", "cue", "trackCueValue")
TRACK_CLASSES = ("trackFormat", "trackValue", "tlToglerOff", "meta-music")
CUE = r"^\d{1,2}:\d{1,2}(?::\d{2})?$"
LEAST_UNTIMED = 5


def lines(text: str) -> Column:
    """Array of the text's lines; a last empty line doesn't count."""
    parts = F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return once(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def timed_lines(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """Lines that open with a time stamp (E1); lines without a title give nothing. Order: start, then position."""
    part = lambda line, group: F.regexp_extract(line, TIMED_LINE, group)
    # other lines have an empty title
    one = lambda line: F.struct(clock_seconds(part(line, 1)).alias("start_sec"), split_name(part(line, 2)).alias("n"))
    rows = docs.select(key, F.posexplode(F.transform(lines(text), one)).alias("ord", "r"))
    return rows.where("r.n.title <> ''").select(key, "ord", "r.start_sec", "r.n.artist", "r.n.title", F.lit(source).alias("source"))


def untimed_lines(docs: DataFrame, text: str, key: str, source: str, least: int = LEAST_UNTIMED) -> DataFrame:
    """Numbered or bulleted names without times (E2), if the text has the keyword and ``least`` such lines."""
    name = lambda line: F.when(~line.rlike(TIMED_LINE), split_name(F.regexp_extract(line, UNTIMED_LINE, 1)))
    named = F.filter(F.transform(lines(text), lambda line, i: F.struct(i.alias("ord"), name(line).alias("n"))), lambda r: r["n"]["title"] != "")
    enough = once(named, lambda x: F.when(F.size(x) >= least, x))
    rows = docs.where(F.col(text).rlike(LIST_KEYWORD)).select(key, F.explode(enough).alias("r"))
    return rows.select(key, "r.ord", F.lit(None).cast("double").alias("start_sec"), "r.n.artist", "r.n.title", F.lit(source).alias("source"))


def chapters(docs: DataFrame, meta: str, key: str, source: str) -> DataFrame:
    """Chapter marks of a metadata JSON (E3), generic ones left out, in their own order. Bad JSON gives nothing."""
    kind = "struct<chapters:array<struct<start_time:double,end_time:double,title:string>>>"
    name = lambda t: F.when((t != "") & ~t.rlike(GENERIC_CHAPTER), split_name(F.regexp_replace(t, TRACK_NUMBER, "")))
    one = lambda c: F.when(c["start_time"].isNotNull(), F.struct(c["start_time"].alias("start_sec"), once(strip(c["title"]), name).alias("n")))
    rows = docs.select(key, F.posexplode(F.transform(F.from_json(F.col(meta), kind)["chapters"], one)).alias("ord", "r"))
    return rows.where("r.n.title <> ''").select(key, "ord", "r.start_sec", "r.n.artist", "r.n.title", F.lit(source).alias("source"))


def wiki_tracks(docs: DataFrame, text: str, key: str, source: str = "mixesdb") -> DataFrame:
    """Names in the tracklist section of a wiki page (E4): from its heading to the first other heading."""
    heading = lambda line: line.rlike(WIKI_HEADING)
    other = lambda r: r["line"].startswith("==") & r["line"].endswith("==") & ~heading(r["line"])
    first = lambda rows, is_it: F.array_position(F.transform(rows, is_it), F.lit(True)).cast("int")
    numbered = F.transform(lines(text), lambda line, i: F.struct(i.alias("ord"), strip(line).alias("line")))
    inside = once(numbered, lambda a: once(first(a, lambda r: heading(r["line"])), lambda at: F.when(at > 0, F.slice(a, at, F.size(a)))))
    section = once(inside, lambda a: once(first(a, other), lambda at: F.when(at > 0, F.slice(a, F.lit(1), at - 1)).otherwise(a)))
    part = lambda line, group: F.regexp_extract(line, WIKI_TRACK, group)
    name = lambda line: once(part(line, 1), lambda a: F.when(a != "", F.struct(strip(a).alias("artist"), strip(part(line, 2)).alias("title"))))
    rows = docs.select(key, F.explode(F.transform(section, lambda r: F.struct(r["ord"].alias("ord"), name(r["line"]).alias("n")))).alias("r"))
    return rows.where("r.n is not null").select(key, "r.ord", F.lit(None).cast("double").alias("start_sec"), "r.n.artist", "r.n.title", F.lit(source).alias("source"))


class _Rows(HTMLParser):
    """Texts of ``div id=tlp_*`` rows: the whole row's and those of its elements, by class."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[list[str], list[tuple[set[str], list[str]]]]] = []
        self.open: list[tuple[str, int, int]] = []  # tag, rows and elements that it began
        self.inside = 0  # open rows

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        row = tag == "div" and (a.get("id") or "").startswith("tlp_")
        if row:
            self.rows.append(([], []))
            self.inside += 1
            self.open.append((tag, len(self.rows) - 1, -1))
        elif self.inside:
            self.rows[-1][1].append((set((a.get("class") or "").split()), []))
            self.open.append((tag, -1, len(self.rows[-1][1]) - 1))
        else:
            self.open.append((tag, -1, -1))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.inside -= sum(o[1] >= 0 for o in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data):
        text = data.strip()
        if self.inside and text:
            self.rows[-1][0].append(text)
            for _, _, e in self.open:
                if e >= 0:
                    self.rows[-1][1][e][1].append(text)


#: A tag in its plainest form and the text behind it, without character references; what a parser reads otherwise is none.
_PLAIN = re.compile(r"<(/?)([a-z][a-z0-9]*)((?: [a-z]+=\"[^\"<>&]*\")*)>([^<&]*)")
_ATTRIBUTE = re.compile(r" ([a-z]+)=\"([^\"]*)\"")
#: Elements whose content isn't markup.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _read(page: str) -> _Rows:
    """The page's rows. Pages of plain tags alone are read by one pattern, others by the parser, with the same calls."""
    rows, end = _Rows(), 0
    for m in _PLAIN.finditer(page):
        closes, tag, attributes, data = m.groups()
        if m.start() != end or tag in _RAW or (closes and attributes):
            break
        end = m.end()
        if closes:
            rows.handle_endtag(tag)
        else:
            rows.handle_starttag(tag, _ATTRIBUTE.findall(attributes))
        if data:
            rows.handle_data(data)
    if end < len(page):
        rows = _Rows()
        rows.feed(page)
    return rows


def _page_rows(page: str) -> list[tuple[str | None, str]]:
    """(cue text or null, track text) of each row of a tracklist page."""
    out = []
    for texts, elements in _read(page or "").rows:
        named: dict[str, list[str]] = {}  # the first element of each class
        for classes, own in elements:
            for name in classes:
                named.setdefault(name, own)
        cue = next((" ".join(named[c]) for c in CUE_CLASSES if c in named), "")
        track = next((" ".join(named[c]) for c in TRACK_CLASSES if named.get(c)), "")
        if not track:
            track = " ".join(texts)
            track = track[len(cue) :].strip() if cue and track.startswith(cue) else track
        if track := " ".join(track.split()):
            out.append((cue, track))
    return out


def tracklist_pages(pages: DataFrame, page: str, key: str, source: str = "1001tracklists") -> DataFrame:
    """Rows of tracklist pages (E5), exact repeats once. Only the markup is read in Python, batch by batch."""

    @F.arrow_udf("array<struct<cue:string,track:string>>")
    def rows_of(texts: pa.Array) -> pa.Array:
        found = [_page_rows(t) for t in texts.to_pylist()]
        ends = pa.array(list(accumulate(map(len, found), initial=0)), pa.int32())
        columns = zip(*chain.from_iterable(found), strict=True) if any(found) else ([], [])
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["cue", "track"]))

    titled = lambda r, n: F.struct(n["artist"].alias("artist"), F.when(n["title"] == "", r["track"]).otherwise(n["title"]).alias("title"))
    one = lambda r: F.struct(F.when(r["cue"].rlike(CUE), clock_seconds(r["cue"])).alias("start_sec"), once(split_name(r["track"]), lambda n: titled(r, n)).alias("n"))
    rows = pages.select(key, F.posexplode(F.transform(rows_of(F.col(page)), one)).alias("ord", "r")).select(key, "ord", "r.start_sec", "r.n.artist", "r.n.title", F.lit(source).alias("source"))
    first = Window.partitionBy(key, "start_sec", same_key("artist"), same_key("title")).orderBy("ord")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def meta_tags(page: Column) -> Column:
    """array(struct(name, content)) of the page's meta tags that have both, in page order."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"(?i)\s(?:property|name)\s*=\s*[\"']([^\"']*)[\"']", 1))
    content = lambda t: F.regexp_extract(t, r"(?i)\scontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    wanted = r"^(og:|music:|twitter:title$)"
    return F.filter(F.transform(tags, lambda t: F.struct(name(t).alias("name"), content(t).alias("content"))), lambda t: t["name"].rlike(wanted))


def page_links(pages: DataFrame, page: str, key: str, most: int, pattern: str = r"<a\s[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>") -> DataFrame:
    """The first ``most`` distinct links of a page in page order, with their white space collapsed."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(page), F.lit(pattern), F.lit(0))).alias("pos", "tag"))
    rows = found.select(key, "pos", F.regexp_extract("tag", pattern, 1).alias("href"), strip(F.regexp_replace(F.regexp_extract("tag", pattern, 2), r"\s+", " ")).alias("anchor"))
    rows = rows.groupBy(key, "href").agg(F.min(F.struct("pos", "anchor")).alias("f"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("f.pos")))
    return rows.where(F.col("rank") <= most).select(key, "rank", "href", F.col("f.anchor").alias("anchor"))


def acoustid_match(response: Column) -> Column:
    """struct(score, recording_id, title, artist) of the first usable result, else null."""
    kind = "struct<status:string,results:array<struct<score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>>>>>>"
    one = lambda r: F.transform(
        r["results"],
        lambda x: F.struct(
            F.coalesce(x["score"], F.lit(0.0)).alias("score"), F.get(x["recordings"], F.lit(0))["id"].alias("recording_id"), F.coalesce(F.get(x["recordings"], F.lit(0))["title"], F.lit("")).alias("title"),
            F.coalesce(F.array_join(F.transform(F.get(x["recordings"], F.lit(0))["artists"], lambda a: F.coalesce(a["name"], F.lit(""))), ", "), F.lit("")).alias("artist"),
        ),
    )
    return once(F.from_json(response, kind), lambda r: F.when(r["status"] == "ok", F.get(F.filter(one(r), lambda x: (x["title"] != "") | (x["artist"] != "")), F.lit(0))))


def acrcloud_match(response: Column) -> Column:
    """struct(score, title, artist) of the first music entry, score out of 100, else null."""
    kind = "struct<status:struct<code:int>,metadata:struct<music:array<struct<title:string,artists:array<struct<name:string>>,score:double>>>>"
    names = lambda m: F.filter(F.transform(m["artists"], lambda a: a["name"]), lambda n: n != "")
    first = lambda code, m: F.when((code == 0) & m.isNotNull(), F.struct((m["score"] / 100).alias("score"), m["title"].alias("title"), F.coalesce(F.array_join(names(m), ", "), F.lit("")).alias("artist")))
    found = lambda r: F.struct(r["status"]["code"].alias("code"), F.get(r["metadata"]["music"], F.lit(0)).alias("m"))
    return once(once(F.from_json(response, kind), found), lambda x: first(x["code"], x["m"]))


def shazam_isrc(response: Column) -> Column:
    """The last metadata text titled ``isrc`` of all sections."""
    kind = "struct<track:struct<title:string,subtitle:string,sections:array<struct<metadata:array<struct<title:string,text:string>>>>>>"
    track = F.from_json(response, kind)["track"]
    all_ = F.flatten(F.transform(track["sections"], lambda s: F.coalesce(s["metadata"], F.array().cast("array<struct<title:string,text:string>>"))))
    return F.try_element_at(F.transform(F.filter(all_, lambda m: F.lower(m["title"]) == "isrc"), lambda m: m["text"]), F.lit(-1))


def genius_hit(response: Column) -> Column:
    """struct(id, title, artist) of the first hit if it has a title or an artist."""
    kind = "struct<response:struct<hits:array<struct<result:struct<id:bigint,title:string,primary_artist:struct<name:string>>>>>>"
    hit = lambda r: F.when((F.coalesce(r["title"], F.lit("")) != "") | (F.coalesce(r["primary_artist"]["name"], F.lit("")) != ""), F.struct(r["id"].alias("id"), r["title"].alias("title"), r["primary_artist"]["name"].alias("artist")))
    return once(F.get(F.from_json(response, kind)["response"]["hits"], F.lit(0))["result"], hit)


def model_picks(answers: DataFrame, text: str, key: str) -> DataFrame:
    """(key, segment_index, candidate_index) picks in a model's answer (E10): the outermost braces as JSON, the last
    pick of a segment; answers without JSON give nothing."""
    kind = "struct<picks:array<struct<segment_index:string,candidate_index:string>>>"
    body = F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0)
    rows = answers.select(key, F.posexplode(F.from_json(body, kind)["picks"]).alias("pos", "p")).withColumn("segment_index", F.col("p.segment_index").try_cast("int"))
    return rows.where("segment_index is not null").groupBy(key, "segment_index").agg(F.max_by(F.col("p.candidate_index").try_cast("int"), "pos").alias("candidate_index"))


def last_json_line(log: Column) -> Column:
    """The last line of a log that opens a JSON object."""
    return F.try_element_at(F.filter(F.split(log, r"\r?\n"), lambda x: F.ltrim(x).startswith("{")), F.lit(-1))
