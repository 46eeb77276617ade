import base64
import hashlib
import hmac

import numpy as np
import pyarrow as pa
import pytest
from cuewright.functions import extract, signal, text
from cuewright.operators import matching, similarity
from cuewright.sources import audio
from pyspark.sql import functions as F


def test_timed_lines(spark):
    page = "Live set\n00:00 Artist One - Track Title\n03:45 Artist Two – Other Track\r\n1:23:45 [Artist Three] - Late Track\n1. 06:30 Numbered Artist - Numbered Track\n07:15 No Separator Title Goes Here\nbye\n"
    got = extract.timed_lines(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, t string"), "t", "id", "d").orderBy("start_sec").collect()
    assert [(r.start_sec, r.artist, r.title) for r in got] == [
        (0, "Artist One", "Track Title"), (225, "Artist Two", "Other Track"), (390, "Numbered Artist", "Numbered Track"), (435, "", "No Separator Title Goes Here"), (5025, "Artist Three", "Late Track"),
    ]


def test_names_and_keys(spark):
    df = spark.createDataFrame([("A - B - C",), ("A – B",), ("Title Only",), ("[A] | (B)",), ("A | B - C",)], "x string").select(text.split_name("x").alias("n"))
    assert [tuple(r.n) for r in df.collect()] == [("A", "B - C"), ("A", "B"), ("", "Title Only"), ("A", "B"), ("A | B", "C")]
    assert spark.createDataFrame([(" Beyoncé — Halo! ",)], "x string").select(text.fold_key("x").alias("k")).head().k == "beyoncé  halo"
    stamps = spark.createDataFrame([("3:05",), ("1:00:01",), ("x",)], "x string").select(text.clock_seconds("x").alias("s")).collect()
    assert [r.s for r in stamps] == [185, 3601, 0]
    clocks = spark.createDataFrame([(-3.0,), (59.9,), (3600.0,)], "x double").select(text.clock("x").alias("s")).collect()
    assert [r.s for r in clocks] == ["00:00", "00:59", "01:00:00"]


def test_untimed_wiki_chapters(spark):
    five = "Tracklist\n" + "\n".join(f"{k}. A{k} - T{k}" for k in range(5))
    docs = spark.createDataFrame([(1, five), (2, five.replace("Tracklist", "follow")), (3, five.rsplit("\n", 1)[0])], "id long, t string")
    assert {r.id for r in extract.untimed_lines(docs, "t", "id", "d").collect()} == {1}
    wiki = "== Description ==\n# No - No\n== Tracklist ==\n# [[Burna Boy]] - [[Last Last]]\n# 2. B - C\n#Artist Three - D\n== Comments ==\n# X - Y"
    got = extract.wiki_tracks(spark.createDataFrame([(1, wiki), (2, "# A - B")], "id long, t string"), "t", "id").orderBy("ord").collect()
    assert [(r.artist, r.title) for r in got] == [("Burna Boy", "Last Last"), ("B", "C"), ("Artist Three", "D")]
    meta = '{"chapters":[{"start_time":0,"title":"Intro"},{"start_time":200,"title":"Burna Boy - Last Last"},{"start_time":420,"title":"02. Asake - Lonely At The Top"},{"start_time":600,"title":"ID"},{"start_time":800,"title":"Outro / ID"},{"title":"x - y"},{"start_time":1,"title":""}]}'
    got = extract.chapters(spark.createDataFrame([(1, meta), (2, "{}"), (3, "nope"), (4, None)], "id long, m string"), "m", "id", "c").collect()
    assert [(r.start_sec, r.artist, r.title) for r in got] == [(200, "Burna Boy", "Last Last"), (420, "Asake", "Lonely At The Top")]


def test_urls_and_phrases(spark):
    kinds = {"https://youtu.be/x": "youtube", "music.youtube.com/": "youtube", " http://www.soundcloud.com/a": "soundcloud", "https://mixcloud.com/a": "mixcloud", "https://www.mixesdb.com/w": "mixesdb", "/tmp/a.mp3": None, "": None}
    got = spark.createDataFrame([(k,) for k in kinds], "u string").select("u", text.url_kind("u").alias("k")).collect()
    assert {r.u: r.k for r in got} == kinds
    words = "yeah, I been walking down the avenue thinking about you, ay ay"
    row = spark.createDataFrame([(words,)], "t string").select(text.clean_phrase("t").alias("p"), text.phrase_passes(text.clean_phrase("t")).alias("ok"), text.hmac_sha1("t", "key").alias("h")).head()
    assert row.p == "I been walking down the avenue thinking about you" and row.ok
    assert row.h == base64.b64encode(hmac.new(b"key", words.encode(), hashlib.sha1).digest()).decode()


def test_similarity_takes_first_over_early(spark):
    r = np.random.default_rng(1)
    q = r.integers(0, 1 << 32, 40)
    near = q.copy()
    near[0] ^= 1
    lib = np.concatenate((near, q, q))
    assert similarity.best_alignment(q.astype(np.uint32), lib.astype(np.uint32)) == (1 - 1 / 1280, 0)
    for queries in (q, q[:7], r.integers(0, 1 << 32, 9)):
        tracks = [lib, q, q[:3], r.integers(0, 1 << 32, 200), np.empty(0, np.int64)]
        for own, cells, n in similarity.padded(pa.array([t.tolist() for t in tracks], pa.list_(pa.int64()))):
            score, at = similarity.alignments(queries.astype(np.uint32), cells, n)
            assert [(s, a) for s, a in zip(score, at)] == [similarity.best_alignment(queries.astype(np.uint32), tracks[i].astype(np.uint32)) for i in own]
    found = similarity.top_matches(spark.createDataFrame([(1, 0, q.tolist()), (2, 0, None)], "query_id long, pitch_ord int, hashes array<long>"), spark.createDataFrame([(7, lib.tolist()), (8, None)], "track_id long, hashes array<long>"), 2, 0.9)
    assert [tuple(x)[:3] for x in found.collect()] == [(1, 1, 7)]


def test_candidates(spark):
    c = spark.createDataFrame([("m", 0, 0, "A", "x", 0.6, "library"), ("m", 0, 1, "B", "y", 0.92, "acoustid"), ("m", 1, 0, "C", "z", 0.2, "library")], "mix string, segment int, candidate_index int, artist string, title string, score double, source string")
    assert [r.artist for r in matching.greedy_pick(c, ["mix", "segment"]).collect()] == ["B"]
    answers = spark.createDataFrame([("m", 'so: {"picks": [{"segment_index": 0, "candidate_index": 0}, {"segment_index": "x"}]} ok'), ("n", "nothing")], "mix string, a string")
    picks = extract.model_picks(answers, "a", "mix").withColumnRenamed("segment_index", "segment")
    assert [r.artist for r in matching.apply_picks(c, picks, "mix", "segment").collect()] == ["A"]
    none = picks.withColumn("candidate_index", F.lit(None).cast("int"))
    assert matching.apply_picks(c, none, "mix", "segment").count() == 0
    scores = spark.createDataFrame([(1, 0.9), (1, 0.6)], "k int, score double")
    assert matching.upper_median_gate(scores, ["k"]).head().median == 0.9


def test_responses(spark):
    ok = '{"status":"ok","results":[{"score":0.9,"recordings":[]},{"score":0.8,"recordings":[{"id":"r","title":"T","artists":[{"name":"A"},{"name":"B"}]}]}]}'
    df = spark.createDataFrame([(ok,), ('{"status":"error"}',), (None,)], "r string").select(extract.acoustid_match(F.col("r")).alias("m"))
    assert [r.m and tuple(r.m) for r in df.collect()] == [(0.8, "r", "T", "A, B"), None, None]
    acr = '{"status":{"code":0},"metadata":{"music":[{"title":"T","artists":[{"name":"A"}],"score":87}]}}'
    df = spark.createDataFrame([(acr,), ('{"status":{"code":1001}}',)], "r string").select(extract.acrcloud_match(F.col("r")).alias("m"))
    assert [r.m and r.m.score for r in df.collect()] == [0.87, None]


def test_tier2(spark):
    cols = "mix string, ord int, start_sec double, end_sec double, artist string, title string, score double, source string"
    t = spark.createDataFrame([("m", 0, 0.0, 60.0, "A", "X", 0.95, "s")], cols)
    u = spark.createDataFrame([("m", 1, 60.0, 90.0), ("m", 2, 120.0, 150.0)], "mix string, ord int, start_sec double, end_sec double")
    for score, start, n, left in ((0.92, 60.0, 2, 1), (0.70, 60.0, 1, 2), (0.99, 0.0, 1, 2)):
        m = spark.createDataFrame([("m", 9, start, start + 30, "B", "Y", score, 2)], cols.replace("source string", "pitch int"))
        tracks, rest = matching.tier2_merge(t, u, m, "mix")
        assert (tracks.count(), rest.count()) == (n, left)


def test_signal(spark, tmp_path):
    t = np.arange(22_050) / 22_050
    low, high = np.sin(2 * np.pi * 40 * t), np.sin(2 * np.pi * 1000 * t)
    rms = lambda x: np.sqrt(np.mean(x**2))
    assert rms(signal.highpass_array(low, 22_050)) < 0.2 * rms(low) and rms(signal.highpass_array(high, 22_050)) > 0.95 * rms(high)
    quiet = signal.normalised_array(0.01 * high, 22_050)
    assert abs(signal.loudness(quiet, 22_050) + 16) < 0.1
    (tmp_path / "a.WAV").write_bytes(signal.wav_bytes(0.5 * high, 22_050))
    (tmp_path / "b.txt").write_text("no")
    chunks = audio.wav_chunks(audio.audio_files(spark, str(tmp_path)), seconds=1).collect()
    assert len(chunks) == 1 and abs(rms(np.array(chunks[0].samples)) - rms(0.5 * high)) < 1e-3
    assert spark.createDataFrame([(low[:2000].tolist(),), (None,)], "x array<double>").select(signal.highpass("x", 22_050).alias("y")).collect()[1].y is None


def test_answers_are_parsed_once(spark):
    rows = spark.range(1).select(F.col("id").cast("string").alias("a"))
    for match in (extract.acoustid_match, extract.acrcloud_match, extract.genius_hit):
        found = rows.select(match(F.col("a")).alias("m")).select("m.title", "m.artist", "m")
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_plain_pages_are_read_without_the_parser(spark, monkeypatch):  # F7
    row = '<div id="tlp_{0}" class="a b"><span class="cueValueField">{0}:07</span><br><b><span class="trackValue"> A{0} - T </span>x</b></div>\n'
    plain = "<html><body><div>out" + "".join(row.format(k) for k in range(3)) + "</div><p>after</p></body></html>"
    odd = [plain.replace("<br>", "<br/>"), plain.replace("A1", "A&amp;1"), plain.replace("</b>", "</b><!-- c -->"), plain.replace("x<", "x < y<"), plain + "<script>'<div id=\"tlp_9\">'</script>", "text " + plain, "", plain + "<div"]
    want = []
    for page in [plain, *odd]:
        parser = extract._Rows()
        parser.feed(page)
        want.append(parser.rows)
    assert [extract._read(page).rows for page in [plain, *odd]] == want and len(want[0]) == 3
    monkeypatch.setattr(extract._Rows, "feed", None)
    assert extract._page_rows(plain) == [(f"{k}:07", f"A{k} - T") for k in range(3)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_matched_once_a_group(spark):  # F9
    docs = spark.createDataFrame([(1, "x\n1. [0:10] A [live] - (B)\n\n0:20 ()\n1:00:00 – solo\n")], "id long, t string")
    rows = extract.timed_lines(docs, "t", "id", "d")
    assert [(r.ord, r.start_sec, r.artist, r.title) for r in rows.collect()] == [(1, 10.0, "A [live]", "B"), (4, 3600.0, "", "solo")]
    assert _plan(rows).count(extract.TIMED_LINE) <= 2


def test_untimed_lists_need_no_window(spark):  # F8
    text = "Tracklist:\n" + "".join(f"{k}) A - B{k}\n" for k in range(5)) + "1. 0:10 C - D\n- ()- \n"
    docs = spark.createDataFrame([(1, text), (1, text.replace("B4", "")), (2, None)], "id long, t string")
    rows = extract.untimed_lines(docs, "t", "id", "d")
    assert [(r.id, r.ord, r.title) for r in rows.collect()] == [(1, k + 1, f"B{k}") for k in range(5)]
    assert "Window" not in _plan(rows) and _plan(rows).count(extract.UNTIMED_LINE) == 1


def test_wiki_sections_need_no_window(spark):  # F13
    page = "# N - O\n == Tracklist ==\n# A - B\n==track list==\n# C - D\n== x\n#E - F \n==Other==\n# G - H\n== Tracklist ==\n# I - J"
    rows = extract.wiki_tracks(spark.createDataFrame([(1, page), (2, "# A - B"), (3, None)], "id long, t string"), "t", "id")
    assert [(r.id, r.ord, r.artist, r.title) for r in rows.collect()] == [(1, 2, "A", "B"), (1, 4, "C", "D"), (1, 6, "E", "F")]
    assert "Window" not in _plan(rows)


def test_chapter_names_are_split_once(spark):  # F15
    meta = '{"chapters":[{"start_time":1,"title":"\\u2003 01. A | B "},{"start_time":2,"title":" "},{"title":"C - D"},{"start_time":4,"title":"Outro"}]}'
    rows = extract.chapters(spark.createDataFrame([(1, meta), (2, None)], "id long, m string"), "m", "id", "c")
    assert [(r.ord, r.start_sec, r.artist, r.title) for r in rows.collect()] == [(0, 1.0, "A", "B")]
    assert _plan(rows).count(extract.TRACK_NUMBER) == 1


def test_alignments_two_hashes_at_a_time():  # F5
    r = np.random.default_rng(4)
    lengths = np.array([0, 3, 5, 9, 9, 12, 40])
    tracks = r.integers(0, 1 << 32, (len(lengths), 40), dtype=np.uint32)
    query = r.integers(0, 1 << 32, 5, dtype=np.uint32)
    tracks[4, 2:7], tracks[5, 1:6], tracks[5, 6:11] = query, query ^ np.uint32(1 << 7), query
    for wanted in (query, query[:4], query[:1], np.tile(query, 8), query[:0]):
        want = [similarity.best_alignment(wanted, t[:n]) for t, n in zip(tracks, lengths, strict=True)]
        flat, pairs = similarity.turned(tracks)
        score, at = similarity.bounded_alignments(wanted, flat, pairs, lengths, -1.0)
        assert list(zip(score.tolist(), at.tolist(), strict=True)) == want
        bounded = similarity.bounded_alignments(wanted, flat, pairs, lengths, 0.6)[0]
        assert all(a == b or (a == -1 and b < 0.6) for a, b in zip(bounded.tolist(), score.tolist(), strict=True))


@pytest.mark.parametrize("q", [5, 24, 32, 45])
def test_sieve_misses_no_alignment(q):
    """Hashes whose upper bits repeat their sign: a sieve by signs finds what comparing every bit finds, and compares few alignments further."""
    rng = np.random.default_rng(q)
    lengths = rng.integers(0, 80, 60)
    tracks = [(rng.normal(0, 8192, n).astype(np.int64) % 2**32).astype(np.uint32) for n in lengths]
    queries = (rng.normal(0, 8192, (3, q)).astype(np.int64) % 2**32).astype(np.uint32)
    for i in np.nonzero(lengths >= q)[0][:4]:
        tracks[i][:q] = queries[1]
        tracks[i][: i % 3] ^= np.uint32(5)
    cells = np.zeros((60, 80), np.uint32)
    for own, track in zip(cells, tracks, strict=True):
        own[: len(track)] = track
    run = similarity.widest_run(similarity.turning_bits(cells) | similarity.turning_bits(queries))
    signs, rests, _ = similarity.sieve_words(np.ascontiguousarray(cells.T), *run)
    words = similarity.query_words(queries, *run)
    assert run[1] >= 15 and len(words) == -(-q // 32) + -(-q // 4)
    want = [[similarity.best_alignment(h, t) for t in tracks] for h in queries]
    for floor in (0.5, 0.75, 0.99):
        bounds = np.array([0.6, floor, floor])
        for k in (0, 2):
            found = [f for f in zip(*(c.tolist() for c in similarity.sieved(q, words, signs, rests, lengths, bounds, k)), strict=True) if f[2] >= bounds[f[0]]]
            assert all(want[i][row] == (score, at) for i, row, score, at in found)
            for i, bound in enumerate(bounds):
                best = sorted((-s, row) for row, (s, _) in enumerate(want[i]) if s >= bound)
                assert sorted((-s, row) for j, row, s, _ in found if j == i)[: k or None] == (best[:k] if k else best)


def test_top_matches_through_sieve(spark, monkeypatch):
    """Variants of several lengths, tracks of several lengths, a track that comes twice, and calls of a few alignments each."""
    rng = np.random.default_rng(9)
    tracks = [(i, (rng.normal(0, 8192, int(rng.integers(0, 70))).astype(np.int64) % 2**32).tolist()) for i in range(120)]
    tracks += [(200, tracks[3][1]), (200, tracks[3][1]), (201, None)]
    queries = [(i, v, (rng.normal(0, 8192, n).astype(np.int64) % 2**32).tolist()) for i in range(5) for v, n in enumerate((12, 20, 12))] + [(7, 0, tracks[5][1][:8]), (7, 1, tracks[5][1][:8]), (8, 0, [])]
    hashes = lambda x: np.asarray(x or [], np.int64).astype(np.uint32)
    want = []
    for query in {q for q, _, _ in queries}:
        own = [hashes(h) for q, _, h in queries if q == query]
        best = sorted((-s, track, at) for track, t in tracks for s, at in [max((similarity.best_alignment(h, hashes(t)) for h in own), key=lambda f: f[0])] if s >= 0.55)
        want += [(query, rank, track, -s, at) for rank, (s, track, at) in enumerate(best[:3], 1)]
    frames = spark.createDataFrame(queries, "query_id long, pitch_ord int, hashes array<long>"), spark.createDataFrame(tracks, "track_id long, hashes array<long>").coalesce(2)
    for aligned in (similarity._ALIGNED, 700):
        monkeypatch.setattr(similarity, "_ALIGNED", aligned)
        assert sorted(map(tuple, similarity.top_matches(*frames, 3, 0.55).collect())) == sorted(want) and len(want) > 12
