"""The corpus operators' queries, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import chat, codebooks, decontaminate, exact_dedup, html_blocks, lm_score, mixing, pii, quality, simhash_vp, spelling, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    done = chat.format_chat(chat.as_records(rows)).select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("pieces")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l,
    sum(length('<|turn|><|text|><|end|>') + length(role) + length(text)
      + len(regexp_extract_all(role, '[<\[]\\*(\|(?:turn|text|end)\|>|/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(\|(?:turn|text|end)\|>|/?s>|/?INST\])')))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM k
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.simhash_report(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, 2 * source_size AS cap, sum(source_size) OVER () * 1.5 AS total FROM s),
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
l AS (SELECT (total - capped) / free AS rate FROM o WHERE (total - capped) / free <= cap / w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT rate FROM l), 2 * total))::DOUBLE AS target FROM o),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT % source_size ELSE 0 END AS rest
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p),
f AS (SELECT *, rest > 0 AND upto <= rest AS inside, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM c),
m AS (SELECT source, arg_min(doc_id, (abs(gap - size), u, doc_id)) AS doc_id FROM f WHERE NOT inside AND rest > 0 AND abs(gap - size) < gap GROUP BY source)
SELECT f.doc_id, size, source_size, target, (size * (passes + (inside OR m.doc_id IS NOT NULL)::INTEGER))::BIGINT AS taken
FROM f LEFT JOIN m ON m.doc_id = f.doc_id AND m.source IS NOT DISTINCT FROM f.source
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_report(_table(spark, sf_dir, "embeddings"))


# vectors of 64 components: parts of four
_ASSIGN_SQL = """
a{n} AS MATERIALIZED (SELECT r, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, e.p, c, (e.x1 - b.x1) ** 2 + (e.x2 - b.x2) ** 2 + (e.x3 - b.x3) ** 2 + (e.x4 - b.x4) ** 2 AS d
  FROM (SELECT r, p, x1::HUGEINT AS x1, x2::HUGEINT AS x2, x3::HUGEINT AS x3, x4::HUGEINT AS x4 FROM e) e JOIN b{n} b ON e.p = b.p) GROUP BY r, p)"""
_MEAN_SQL = """
m{n} AS (SELECT p, c, count(*) AS n, sum(x1)::BIGINT AS s1, sum(x2)::BIGINT AS s2, sum(x3)::BIGINT AS s3, sum(x4)::BIGINT AS s4 FROM e JOIN a{n} USING (r, p) GROUP BY p, c),
b{next} AS MATERIALIZED (SELECT p, c, """ + ", ".join(f"coalesce((s{i} - (s{i} % n + n) % n) // n, x{i}) AS x{i}" for i in (1, 2, 3, 4)) + " FROM b{n} LEFT JOIN m{n} USING (p, c))"
OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, p, v[4 * p + 1] AS x1, v[4 * p + 2] AS x2, v[4 * p + 3] AS x3, v[4 * p + 4] AS x4 FROM k, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS c, x1, x2, x3, x4 FROM e WHERE r <= 64),
{_ASSIGN_SQL.format(n=0)}, {_MEAN_SQL.format(n=0, next=1)}, {_ASSIGN_SQL.format(n=1)}, {_MEAN_SQL.format(n=1, next=2)}, {_ASSIGN_SQL.format(n=2)},
f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(c)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 JOIN k USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY p, c)) FROM b2) AS codebooks_sha256 FROM f
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


_OCTET = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(hit, '{_OCTET}(\.{_OCTET}){{3}}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(dig) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(dig)), lambda i: CASE WHEN i % 2 = 0 THEN dig[length(dig) - i]::INT ELSE dig[length(dig) - i]::INT * 2 % 10 + dig[length(dig) - i]::INT // 5 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(dig) BETWEEN 9 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b", "list_reduce(string_split(substr(flat, 5) || left(flat, 4), ''), lambda a, c: CASE WHEN c < 'A' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END, 0) = 1"),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(hit, '^(000|666|9)|-00-|0000$') AND regexp_matches(near, 'social|security|ssn|insurance')"),
    "tel": (r"(\([0-9]{3}\)\x20?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b", r"NOT regexp_matches(gap, '\+[0-9]{1,3}[\x20.-]?$') AND regexp_matches(near, 'phone|call|tel|fax|mobil|anruf|appel|llam')"),
}
_HITS_SQL = " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(range(len(string_split_regex(t, '{pattern}')))) AS i FROM d" for k, (kind, (pattern, _)) in enumerate(_PII_SQL.items()))
_VALID_SQL = " ".join(f"WHEN '{kind}' THEN {valid}" for kind, (_, valid) in _PII_SQL.items())
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), h AS ({_HITS_SQL}),
s AS (SELECT r, k, kind, hit, gap, sum(length(gap) + coalesce(length(hit), 0)) OVER w - coalesce(length(hit), 0) AS st, lower(right(gap, 48) || chr(10) || left(lead(gap) OVER w, 48)) AS near,
  regexp_replace(hit, '[^0-9]', '', 'g') AS dig, replace(hit, ' ', '') AS flat FROM h WINDOW w AS (PARTITION BY r, k ORDER BY i ROWS UNBOUNDED PRECEDING)),
v AS (SELECT r, k, kind, st, kind || ':' || st || ':' || (st + length(hit)) AS x FROM s WHERE hit IS NOT NULL AND CASE kind {_VALID_SQL} END)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(x, ',' ORDER BY k, st) FILTER (k < 4), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY k, st), '') AS spans
FROM d LEFT JOIN v USING (r) GROUP BY r, doc_id
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def _crc_of_nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_CRC_SQL = """(xor(list_reduce(list_transform(range(length(hex({0}))), lambda i: strpos('0123456789ABCDEF', substr(hex({0}), i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1),
  lambda c, x: xor(c >> 4, [{1}][(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT))""".format("key", ", ".join(str(_crc_of_nibble(c)) for c in range(16)))
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{spelling._UPPER}', '{spelling._LOWER}') AS run FROM documents),
g AS MATERIALIZED (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS times FROM t WHERE length(run) >= 7 GROUP BY 1, 2),
c AS (SELECT run, times, {_CRC_SQL} AS h FROM g),
w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM c GROUP BY 1 HAVING sum(times) >= 2 AND length(word) >= 7),
v AS MATERIALIZED (SELECT word, left(word, i) AS a, substr(word, i + 2) AS b FROM w, LATERAL (SELECT unnest(range(length(word))) AS i)),
x AS (SELECT v.word, u.word AS other FROM v JOIN v u ON u.a = v.a AND u.b = v.b AND u.word <> v.word UNION SELECT v.word, w.word FROM v JOIN w ON w.word = v.a || v.b UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.a || v.b),
b AS MATERIALIZED (SELECT x.word, count(*) AS n_near, arg_min(x.other, (-o.n, x.other)) AS best, max(o.n) AS best_n FROM x JOIN w o ON o.word = x.other GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM f JOIN r USING (word) JOIN f e ON e.word = r.root WHERE e.form IS NULL
"""


QUERIES = {"op1_chat_format": op1_chat_format, "op2_quality": op2_quality, "op3_exact_dedup": op3_exact_dedup, "op4_warc": op4_warc, "op5_html_text": op5_html_text, "op6_suffix_dedup": op6_suffix_dedup, "op7_simhash_vp": op7_simhash_vp, "op8_decontaminate": op8_decontaminate, "op9_lm_score": op9_lm_score, "op10_mix_sources": op10_mix_sources, "op11_vector_codes": op11_vector_codes, "op12_pii": op12_pii, "op13_spelling": op13_spelling}
ORACLES = {"op1_chat_format": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op10_mix_sources": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_pii": OP12_SQL, "op13_spelling": OP13_SQL}
