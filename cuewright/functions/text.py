"""Text functions as Column expressions: time stamps, titles, keys, phrases, URLs, signatures (inventory 2.C, 2.D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, separators, gates and lists that results depend on.
LOCKED_HOSTS = ("open.spotify.com", "spotify.com", "music.apple.com")
SUPPORTED_HOSTS = ("youtube.com", "youtu.be", "music.youtube.com", "soundcloud.com", "mixcloud.com", "audiomack.com")
URL_KINDS = (
    ("youtube", r"^(https?://)?(www\.|m\.|music\.)?(youtube\.com|youtu\.be)/"),
    ("soundcloud", r"^(https?://)?(www\.)?soundcloud\.com/"),
    ("mixcloud", r"^(https?://)?(www\.)?mixcloud\.com/"),
    ("mixesdb", r"^(https?://)?(www\.)?mixesdb\.com/"),
)
SEPARATORS = (" - ", " – ", " — ", " | ")
STOP_PHRASES = (
    "i'm going", "i am going", "let go", "let me go", "thank you", "yeah yeah",
    "you know", "i don't know", "come on", "i love you", "i want you",
    "all right", "right now", "right there", "go go go", "oh yeah", "i'm sorry",
    "yes yes", "no no", "i don't care", "i'm not", "you can do it",
)
BLOCK_SIGNS = (
    "unexpected_eof_while_reading",
    "unable to download api page",
    "sign in to confirm",
    "confirm you're not a bot",
    "http error 403",
    "failed to extract any player response",
    "not available on this app",
    "the read operation timed out",
)
SOURCE_PRIORITY = {
    "1001tracklists": 4,
    "mixesdb": 3,
    "youtube_chapters": 2,
    "soundcloud_chapters": 2,
    "mixcloud_chapters": 2,
    "youtube_description": 2,
    "soundcloud_description": 2,
    "mixcloud_description": 2,
    "youtube_description_untimed": 1,
    "soundcloud_description_untimed": 1,
    "mixcloud_description_untimed": 1,
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: White space of any kind: what ``\s`` means to a pattern with Unicode classes.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(x), F.lit(WHITE))


def same_key(x: str | Column) -> Column:
    """Names are the same when their stripped lower-case forms are (D-5)."""
    return F.lower(strip(x))


def fold_key(x: str | Column) -> Column:
    """Key without punctuation (D-4): white space collapses before punctuation goes, so ``a — b`` keeps two blanks."""
    collapsed = F.regexp_replace(same_key(x), r"(?U)\s+", " ")
    return F.regexp_replace(collapsed, r"(?U)[^\w\s]", "")


def source_priority(source: str | Column) -> Column:
    """Rank of a source; unknown sources rank 0."""
    table = F.create_map(*[F.lit(v) for pair in SOURCE_PRIORITY.items() for v in pair])
    return F.coalesce(F.try_element_at(table, _c(source)), F.lit(0))


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named: by itself each mention works it out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clock_seconds(stamp: str | Column) -> Column:
    """``m:s`` or ``h:m:s`` as seconds; anything else is 0 (D-1)."""

    def seconds(parts: Column) -> Column:
        n = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
        return F.when(F.size(parts) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(parts) == 2, n(0) * 60 + n(1)).otherwise(0).cast("double")

    return once(F.split(_c(stamp), ":"), seconds)


def unwrap(x: str | Column) -> Column:
    """Without one pair of brackets or parentheses around the whole (D-2)."""
    return strip(F.regexp_replace(strip(x), r"(?s)^(?:\[(.*)\]|\((.*)\))$", "$1$2"))


def split_name(rest: str | Column) -> Column:
    """struct(artist, title): the first separator, in fixed order, that occurs splits once; none: no artist (D-3)."""

    def split(rest: Column) -> Column:
        out = F.struct(F.lit("").alias("artist"), rest.alias("title"))
        for s in reversed(SEPARATORS):
            pair = F.struct(F.substring_index(rest, s, 1).alias("artist"), F.substring(rest, F.instr(rest, s) + len(s), F.length(rest)).alias("title"))
            out = F.when(rest.contains(s), pair).otherwise(out)
        return out

    names = lambda n: F.struct(unwrap(n["artist"]).alias("artist"), unwrap(n["title"]).alias("title"))
    return once(once(_c(rest), split), names)


def clean_phrase(text: str | Column, most: int = 120) -> Column:
    """The longest clause, first of equals, at most ``most`` long; without clauses the collapsed text (D-6)."""
    flat = strip(F.regexp_replace(F.regexp_replace(_c(text), r"[\[\]()]", " "), r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(flat, r"[.,!?;]"), strip), lambda p: p != "")
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return F.coalesce(F.left(F.get(ranked, F.lit(0))["p"], F.lit(most)), flat)


def phrase_passes(phrase: str | Column, least_words: int = 5, least_distinct: int = 4) -> Column:
    """Enough words, enough different ones, and not a stock phrase."""
    words = F.split(strip(phrase), r"(?U)\s+")
    return (F.size(words) >= least_words) & ~same_key(phrase).isin(*STOP_PHRASES) & (F.size(F.array_distinct(F.transform(words, F.lower))) >= least_distinct)


def word_set(x: str | Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9 (D-7)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9]+"), F.lit(0)))


def url_kind(url: str | Column) -> Column:
    """Platform of a URL by ordered patterns, null if none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(URL_KINDS):
        out = F.when(strip(url).rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def has_host(url: str | Column, hosts: tuple[str, ...]) -> Column:
    """Whether the URL mentions one of the hosts anywhere (C11)."""
    low = F.lower(_c(url))
    return reduce(lambda a, b: a | b, [low.contains(h) for h in hosts])


def url_host(url: str | Column) -> Column:
    """Lower-case host of a URL with scheme and path, every ``www.`` removed; else empty (D-9)."""
    return F.replace(F.lower(F.regexp_extract(_c(url), r"^https?://([^/]+)/", 1)), F.lit("www."), F.lit(""))


def url_cache_key(url: str | Column) -> Column:
    """One key for all share links of a page (D-8)."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    apple, share = host.contains("music.apple.com"), host.contains("spotify")
    path = F.when(apple, F.regexp_replace(path, r"^/[a-zA-Z]{2}/", "/")).otherwise(path)
    query = F.when(apple | share, F.lit("")).otherwise(query)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def block_sign(log: str | Column) -> Column:
    """Whether a download log shows that the platform blocks."""
    return reduce(lambda a, b: a | b, [F.lower(_c(log)).contains(s) for s in BLOCK_SIGNS])


def clock(sec: str | Column) -> Column:
    """``MM:SS``, with hours when there are any; fractions are cut, negative times are 0."""
    s = F.greatest(F.lit(0), _c(sec).cast("long"))
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(F.when(h < 10, two(h)).otherwise(h.cast("string")), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(two(m), F.lit(":"), two(r)))


def hmac_sha1(message: str | Column, secret: str) -> Column:
    """Base64 HMAC-SHA1 (D-11)."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha1(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in key).hex()))
    inner = F.unhex(F.sha1(F.concat(pad(0x36), _c(message).cast("binary"))))
    return F.base64(F.unhex(F.sha1(F.concat(pad(0x5C), inner))))
