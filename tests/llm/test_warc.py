import gzip
import hashlib

from cuewright.llm import warc as W


def brute(rows):
    best = {}
    for i, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(i, best.get(data, i))
    out = []
    for i, h in rows:
        data = (h or "").encode()
        first = best.get(data)
        again = first is not None and (i is None or i < first)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    rows = [(1, tricky), (2, None), (3, ""), (4, "é" * 600), (5, "é" * 600), (6, "short"), (7, "short"), (8, tricky), (9, "x" * 300_000), (9, "y" * 2000), (10, "é" * 600), (None, "é" * 600), (11, "\r\n\r\n" * 300)]
    pages = spark.createDataFrame([(i, f"http://a.b/{i}\r\nX: y?q=1" if i != 3 else None, h, "x") for i, h in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = W.roundtrip(pages, f"{tmp_path}/w")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    captures = W.assemble(W.read_warc(spark, f"{tmp_path}/w")).collect()
    assert len(captures) == len(rows)
    for c in captures:
        assert c.request.concurrent_to == c.metadata[0].concurrent_to == [c.response.record_id] == [c.capture_id] and len(c.metadata) == 1 and not c.others
        assert c.request.block.startswith(b"GET /") or c.request.block.startswith(b"GET  ") or c.request.block.startswith(b"GET")
        assert c.response.record_type == "revisit" or hashlib.sha1(c.response.block.split(b"\r\n\r\n", 1)[1]).hexdigest() == c.response.payload_sha1
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").rglob("*.gz"))
    assert sum(1 for _ in W.parse_records(data)) == 3 * len(rows)


def _records(spark, *rows):
    return spark.createDataFrame([(i, kind, to, "u", None, b"", 0, None) for i, kind, to in rows], W.RECORDS)


def test_assembly_without_some_records(spark):
    got = {c.capture_id: c for c in W.assemble(_records(spark, ("r1", "response", None), ("q1", "request", ["r1"]), ("q0", "request", ["r1"]), ("q2", "request", ["gone"]), ("r2", "revisit", []), ("w", "warcinfo", []))).collect()}
    assert set(got) == {"r1", "r2", "gone", "w"} and got["r1"].request.record_id == "q0" and got["r1"].metadata == [] and got["r2"].request is None
    assert [o.record_id for o in got["r1"].others] == ["q1"] and got["gone"].response is None and [o.record_type for o in got["w"].others] == ["warcinfo"]


def test_assembly_over_several_steps_and_ids(spark):
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["r1"]), ("m0", "metadata", ["r1"]),  # a response names its request
        ("q2", "request", ["r2", "m2"]), ("r2", "response", []), ("m2", "metadata", []), ("m3", "metadata", ["m2"]),  # several names, a chain of metadata
        ("r4", "response", ["m4"]), ("m4", "metadata", ["q4"]), ("q4", "request", ["r4"]), ("r5", "response", None),
    ]
    got = {c.response.record_id: c for c in W.assemble(_records(spark, *rows)).collect()}
    assert {r: (c.request and c.request.record_id, [m.record_id for m in c.metadata]) for r, c in got.items()} == {"r1": ("q1", ["m0", "m1"]), "r2": ("q2", ["m2", "m3"]), "r4": ("q4", ["m4"]), "r5": (None, [])}


def test_repeated_headers(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(head.encode())
    assert [r.concurrent_to for r in W.read_warc(spark, str(tmp_path)).collect()] == [["<a>", "<b>"]]


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 64 << 10)
    pages = spark.createDataFrame([(k, "http://a.b/", str(k) * (2000 if k % 5 else 30_000)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    assert W.roundtrip(pages, f"{tmp_path}/w").count() == 60
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) > 12 and max(sizes) < 5 * (64 << 10)


def test_empty_table(spark, tmp_path):
    assert W.roundtrip(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w").count() == 0


def _foreign(n, size):
    for k in range(n):
        block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + bytes([65 + k % 26]) * size
        yield (f"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:{k}>\r\nWARC-Target-URI: http://a.b/\r\n  {k}\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    records = list(_foreign(40, 1000))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 120 and {(r.record_id, r.uri, r.payload_bytes) for r in got} == {(f"<urn:{k}>", f"http://a.b/ {k}", 1000) for k in range(40)}
    assert {r.payload_sha1 for r in got if r.record_id == "<urn:3>"} == {hashlib.sha1(b"D" * 1000).hexdigest()}


def test_large_archive_is_read_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "large.warc.gz").write_bytes(b"".join(map(gzip.compress, _foreign(60, 2 << 20))))
    got = W.read_warc(spark, str(tmp_path), blocks=False)
    assert got.agg({"payload_bytes": "sum"}).head()[0] == 60 * (2 << 20)


def test_shuffled_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_DIGESTS", 0)
    rows = [(k, "x" * 1500 if k % 2 else str(k % 40) * 1200) for k in range(200)] + [(None, "x" * 1500), (300, "y" * 300_000), (301, "y" * 300_000)]
    for share in (1000, 3):
        monkeypatch.setattr(W, "HOT_SHARE", share)
        pages = spark.createDataFrame([(i, "http://a.b/", h) for i, h in rows], "page_id long, url string, html string")
        assert sorted(map(tuple, W.roundtrip(pages, f"{tmp_path}/w{share}").collect()), key=str) == brute(rows)
