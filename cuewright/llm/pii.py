"""Personal data in texts, by DataFrame functions alone: regular expressions propose spans, checksums confirm them, context adjusts
their score.

A kind is a pattern, a validator and the words that make it likelier. Patterns take whole runs (possessively, from the start of a run or
the end of the match before), so each finds the same leftmost matches as its plain form but reads a text once, however long its runs.
Places are running sums over what lies between matches, in code points. No shuffle, no Python: a row is read, its spans are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import text_or_empty

#: Code points on each side of a span, up to the next match of its kind, in which context words count.
CONTEXT = 48
#: What a context word adds to a score, and the score from which a span counts.
BONUS, LEAST = 0.3, 0.5
#: Running sums are made of stretches of so many matches, so their cost stays near linear.
STRETCH = 256


def _valid_ip(match: Column, before: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _valid_card(match: Column, before: Column) -> Column:
    digits = F.translate(match, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _valid_phone(match: Column, before: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


def _valid_iban(match: Column, before: Column) -> Column:
    """ISO 7064 mod 97: country and check digits moved to the end, letters as 10 to 35, rest 1."""
    flat = F.translate(match, " ", "")
    signs = F.regexp_extract_all(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), F.lit("."), F.lit(0))
    code = lambda c: F.ascii(c)
    rest = F.aggregate(signs, F.lit(0), lambda a, c: F.when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97))
    return rest == 1


def _valid_ssn(match: Column, before: Column) -> Column:
    return ~match.rlike("^(?:000|666|9)|-00-|0000$")


def _valid_tel(match: Column, before: Column) -> Column:
    """Not the rest of a number with a country code."""
    return ~before.rlike(r"\+[0-9]{1,3}[\x20.-]?$")


@dataclass(frozen=True)
class Kind:
    """``valid`` sees a match and what lies before it. ``score`` is a valid match's without context; kinds of ``always`` count whatever their score. A text without ``sign``, which
    every match has, isn't searched further."""

    name: str
    pattern: str
    valid: Callable[[Column, Column], Column]
    score: float
    words: str
    always: bool = False
    sign: str = ""


_ANY = lambda match, before: F.lit(True)
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_FREE, _ENDS = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_CALL = "phone|call|tel|fax|mobil|anruf|appel|llam"
KINDS = (
    Kind("email", rf"(?={_LOCAL})(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", _ANY, 0.7, "mail|contact|write|kontakt|correo|courriel", True, "@"),
    Kind("ip", r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _valid_ip, 0.6, "address|host|server|login|adresse|direcci", True, r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _valid_card, 0.6, "card|visa|credit|payment|karte|carte|tarjeta", True, "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _valid_phone, 0.6, _CALL, True, r"\+[0-9]"),
    Kind("iban", rf"(?=[A-Z]){_FREE}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_ENDS}", _valid_iban, 0.7, "iban|account|bank|konto|compte|cuenta", sign="[A-Z]{2}[0-9]{2}"),
    Kind("ssn", rf"(?=[0-9]){_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_ENDS}", _valid_ssn, 0.3, "social|security|ssn|insurance", sign="[0-9]-[0-9]"),
    Kind("tel", rf"(?:\([0-9]{{3}}\)\x20?|(?=[0-9]){_FREE}[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}{_ENDS}", _valid_tel, 0.3, _CALL, sign="[0-9][.-][0-9]"),
)
_SPAN = "struct<kind:string,start:long,end:long,score:double,text:string>"


def _starts(lengths: str) -> Column:
    """The sum of all elements of a column before each one."""
    n = F.size(lengths)
    stretches = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int")), lambda k: F.slice(lengths, k * STRETCH + 1, STRETCH))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    sums = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])
    return F.flatten(F.zip_with(stretches, sums(F.transform(stretches, total), F.lit(0).cast("long")), sums))


def _spans(kind: Kind, hits: str, gaps: str, starts: str) -> Column:
    """The kind's spans (kind, start, end, score, text) from left to right: matches, what lies between them, where they start."""
    rows = F.arrays_zip(F.col(hits).alias("hit"), F.col(gaps).alias("before"), F.slice(gaps, 2, F.size(hits)).alias("after"), F.col(starts).alias("at"))

    def span(row: Column) -> Column:
        start = row["at"] + F.length(row["before"])
        near = F.lower(F.concat_ws("\n", F.right(row["before"], F.lit(CONTEXT)), F.left(row["after"], F.lit(CONTEXT))))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.words), BONUS).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(row["hit"])).alias("end"), score.alias("score"), row["hit"].alias("text"))

    # the piece after the last match has none
    found = F.transform(F.filter(rows, lambda row: row["hit"].isNotNull() & kind.valid(row["hit"], row["before"])), span)
    kept = found if kind.always else F.filter(found, lambda s: s["score"] >= LEAST)
    return F.when(F.size(hits) > 0, kept).otherwise(F.array()).cast(f"array<{_SPAN}>")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, spans) per row of ``docs``: the personal data in its whole text, by kind in the order of ``kinds``, then start.

    Places are code points, the end exclusive. Spans of different kinds may overlap; of one kind they don't. Kinds of ``always`` stay
    when they are valid; others need the score ``LEAST``, which weak patterns only reach beside a context word. Null and
    empty texts have no spans, repeated rows and null identifiers stay, other columns aren't read, an empty table gives no rows.
    """
    text = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(F.col(f"`{text_col}`")).alias("__text"))
    # a step each, so that no expression is evaluated twice, nor inside a loop over its own elements
    rows = text
    for name, make in (
        ("hits", lambda k: F.when(F.col("__text").rlike(k.sign), F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))),
        ("gaps", lambda k: F.when(F.size(f"__hits_{k.name}") > 0, F.split("__text", k.pattern, -1))),
        ("lengths", lambda k: F.zip_with(F.slice(f"__gaps_{k.name}", 1, F.size(f"__hits_{k.name}")), f"__hits_{k.name}", lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))),
        ("starts", lambda k: F.when(F.size(f"__hits_{k.name}") > 0, _starts(f"__lengths_{k.name}"))),
    ):
        rows = rows.withColumns({f"__{name}_{k.name}": make(k) for k in kinds})
    return rows.select(id_col, F.concat(*[_spans(k, *[f"__{name}_{k.name}" for name in ("hits", "gaps", "starts")]) for k in kinds]).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the kinds that always count, and all spans."""
    base = [k.name for k in KINDS if k.always]
    found = find_spans(docs, id_col, text_col)
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
