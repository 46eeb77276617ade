"""Personal data against Python's plain patterns, and the cases of the docstring."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cuewright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    checks = {"email": True, "ip": all(int(x) <= 255 for x in match.split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
    return checks[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


HARD = [
    None, "", "a@b.c_d@e.f x.y@z w@q.r.s.t@u.v @a.b a@.b a@b. a@b.c", "1.2.3.4.5.6.7.8 001.2.3.0255 300.1.1.1 1.2.3 1..2.3.4", "4111 1111-1111 1111 4111111111111111 0000000000000 😀 12 4 4111--111111111111",
    "+1 (017) 555-7713 +12 3 ++1 222 333 444- +49.(0)30.123456 +1.2.3.4", "é4111111111111111😀a@b.cé\n+1 234 567 890\t" * 900, "1" * 5000 + "." + "2" * 5000 + " " + "9-" * 4000, "a" * 20000 + "@" + "b." * 5000 + "c", "@" * 3000,
]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a@b.c"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("__text", F.lit("x@y.z"))
    found = pii.pii_report(docs).collect()
    assert len(found) == len(rows)
    texts = dict(rows[: len(HARD)])
    for r in found:
        want = base(texts[r["doc_id"]] if r["doc_id"] is not None else "a@b.c")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]


def test_checksums_and_context_add_spans(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 not GB83WEST12345698765432; social security 123-45-6789"
    plain = "number 123-45-6789 of the box, part 212-555-1234"
    call = "call (212) 555-1234 or fax 212.555.1234, +1 (212) 555-1234"
    bad = "ssn 000-12-3456 666-12-3456 123-00-1234 123-45-0000"
    docs = spark.createDataFrame(list(enumerate([text, plain, call, bad])), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    assert [(s["kind"], s["text"]) for s in found[0]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789")]
    assert found[1] == [] and found[3] == []
    assert [(s["kind"], s["text"]) for s in found[2]] == [("phone", "+1 (212) 555-1234"), ("tel", "(212) 555-1234"), ("tel", "212.555.1234")]
    for k, spans in found.items():
        assert all([text, plain, call, bad][k][s["start"] : s["end"]] == s["text"] and 0 < s["score"] <= 1 for s in spans)
    near, far = (pii.find_spans(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()["spans"][0]["score"] for t in ("mail me: a@b.c", "a@b.c"))
    assert near > far


def test_empty_table_and_native_plan(spark, capsys):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_report(docs).collect() == []
    pii.pii_report(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_places_after_many_matches(spark, n):
    text = "ä 4111111111111111 " * n
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(m.start(), m.end()) for m in re.finditer(PLAIN["card"], text) if valid("card", m[0])]
