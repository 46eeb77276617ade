"""WARC writing, reading and transaction assembly.

Every capture becomes three records: the request, the response (or a revisit of an equal payload) and metadata. Request
and metadata name the response in ``WARC-Concurrent-To``. Spark's text writer writes the archives, the two line ends
that close every WARC record being its line separator, so archives go to any file system that Spark knows. Captures of
like size share archives, so that no archive holds much over ``FILE_BYTES`` unless one capture does.
Readers split by ``Content-Length`` alone, so payloads may hold anything, record headers included; they take gzip files of one
member or of one a record, and plain ones, and hold the compressed file and one record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import HOT_SHARE, materialise, new_path, note, scratch
from cuewright.llm.simhash_vp import components

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this many bytes are always written whole.
REVISIT_BYTES = 1000
#: Bytes of payload in one archive, about, and the sizes by which captures go to different archives; larger ones have one each.
FILE_BYTES, SIZES = 64 << 20, (16 << 10, 256 << 10, 4 << 20)
#: Digests of repeated payloads that are sent to all tasks (some hundred bytes each); beyond it, only those of very many pages.
BROADCAST_DIGESTS = 100_000
#: Bytes of records that a reading task passes on at a time.
READ_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it; headers with null values are left out."""
    lines = [F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _clean(value: Column) -> Column:
    """A header value: control characters and blanks of a URL can't break the header."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def page_sizes(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, sha, bytes) of every page's payload, without the payloads."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return materialise(pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload.cast("binary"), 256).alias("sha"), F.octet_length(payload).alias("bytes")), "warc-sizes")


def _with_first(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``first``, the largest identifier of a repeated payload's pages. Pages of a payload that very many have aren't shuffled."""
    firsts = sizes.where(F.col("bytes") >= REVISIT_BYTES).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialise(firsts, "warc-firsts")
    if firsts.count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(firsts.drop("n")), "sha", "left")
    hot = F.col("n") * HOT_SHARE > sizes.count()  # HOT_SHARE digests at most
    rows = rows.join(F.broadcast(firsts.where(hot).select("sha", F.col("first").alias("hot_first"))), "sha", "left")
    # rows that have theirs, and those without identifiers, are spread
    key = F.when(F.col("hot_first").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.col("url"))))
    rows = rows.withColumn("key", key).join(firsts.where(~hot).select(F.col("sha").alias("key"), F.col("first").alias("own_first")), "key", "left")
    return rows.withColumn("first", F.coalesce("hot_first", "own_first")).drop("key", "hot_first", "own_first")


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", sizes: DataFrame | None = None) -> DataFrame:
    """(records, bytes): per page a string array of its request, response or revisit, and metadata record, and its payload's size.

    Null payloads are empty, null URLs empty. Of payloads of at least ``REVISIT_BYTES`` bytes that are equal, the page with the
    largest identifier is the response (null identifiers smallest; rows that repeat it are all responses). ``sizes``: what
    ``page_sizes`` gives.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), _clean(F.col(url_col)).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "sha": F.sha2(F.col("payload").cast("binary"), 256)})
    rows = _with_first(rows, sizes if sizes is not None else page_sizes(pages, id_col, payload_col))
    revisit = F.col("first").isNotNull() & (F.coalesce("id", F.lit(-(1 << 63))) < F.col("first"))
    digest = F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))
    salt = F.uuid()
    named = rows.select("*", F.concat(F.lit("<urn:uuid:"), salt, F.lit(">")).alias("rid"), revisit.alias("revisit"), digest.alias("digest"))
    page = F.col("id").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    path = F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*", "")
    get = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    own = lambda role: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.col("rid"), F.lit(role)).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    target = ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url")))
    date = ("WARC-Date", F.lit(DATE))
    request = _record("request", [("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", F.col("rid")), date, target, ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", F.col("rid")), date, target, ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
            ("WARC-Payload-Digest", F.col("digest")), ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))),
    )
    fields = F.concat(F.lit("pageId: "), F.coalesce(page, F.lit("")), F.lit(CRLF + "refersToPageId: "), F.coalesce(F.when(F.col("revisit"), F.col("first")).cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", [("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", F.col("rid")), date, target, ("Content-Type", F.lit("application/warc-fields"))], fields)
    return named.select(F.array(request, response, metadata).alias("records"), "bytes")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the archives, gzipped, to the folder ``path``. An empty table gives a folder without records."""
    with scratch(pages.sparkSession):
        # the three records of a capture stand in one line of text, so a file's cut never depends on how they are spread
        rows = to_records(pages, id_col, url_col, payload_col, page_sizes(pages, id_col, payload_col)).select(F.array_join("records", CRLF + CRLF).alias("value"), "bytes")
        size, most = F.lit(len(SIZES)), F.lit(1)
        for k in range(len(SIZES) - 1, -1, -1):
            size, most = F.when(F.col("bytes") <= SIZES[k], F.lit(k)).otherwise(size), F.when(F.col("bytes") <= SIZES[k], F.lit(max(1, FILE_BYTES // SIZES[k]))).otherwise(most)
        number = F.monotonically_increasing_id() % (1 << 33)  # of the row in its task
        lines = rows.select("value", size.alias("size"), F.floor(number / most).alias("file"))
        lines.write.partitionBy("size", "file").option("compression", "gzip").option("lineSep", CRLF + CRLF).text(path)


RECORDS = "record_id string, record_type string, concurrent_to array<string>, uri string, digest string, block binary, payload_bytes long, payload_sha1 string"


def parse_records(archive):
    """(headers, block) of each record of an archive, given as bytes or as an open binary file. Header names are lower-cased;
    lines that start with a blank continue the one before; values of a header that is repeated are joined by blanks."""
    file = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    while line := file.readline():
        if not line.strip():
            continue  # the line ends that close a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := file.readline()).strip(b"\r\n"):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = f"{headers[name]} {value.strip()}" if name in headers else value.strip()
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _opened(content: bytes):
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 20) if content[:2] == b"\x1f\x8b" else plain


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of the archives in the folder ``path`` and below: headers, block (null unless ``blocks``), size and SHA-1 of the
    payload. A damaged archive is an error."""
    types = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.binary(), pa.int64(), pa.string()]

    def passed(out: list[list]):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["record_id", "record_type", "concurrent_to", "uri", "digest", "block", "payload_bytes", "payload_sha1"])

    def read(batches):
        out, held = [[] for _ in types], 0
        for batch in batches:
            for content in batch.column("content"):
                for h, block in parse_records(_opened(content.as_py())):
                    http = h["warc-type"] in ("response", "revisit") and h.get("content-type", "").startswith("application/http")
                    payload = memoryview(block)[block.find(b"\r\n\r\n") + 4 :] if http else b""
                    row = (
                        h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to", "").split(), h.get("warc-target-uri"), h.get("warc-payload-digest"),
                        block if blocks or not http else None, len(payload), hashlib.sha1(payload).hexdigest() if http else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    held += 200 + len(row[5] or b"")
                    if held > READ_BYTES:
                        yield passed(out)
                        out, held = [[] for _ in types], 0
        yield passed(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(read, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """``records`` with ``capture_id``, which those share that concurrent-to identifiers connect, over any number of steps.

    Where all identifiers named belong to records that name none themselves, or aren't there, one step says it all: the identifier named. Only
    archives with longer ways are labelled by joins; identifiers alone are shuffled for that.
    """
    named = F.coalesce("concurrent_to", F.array().cast("array<string>"))
    links = materialise(records.select(F.col("record_id").alias("a"), F.explode(named).alias("b")), "warc-links")
    longer = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    if longer.isEmpty() and links.groupBy("a").count().where("count > 1").isEmpty():
        return records.withColumn("capture_id", F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id")))
    labels = components(links).withColumnRenamed("node", "record_id")
    return records.join(labels, "record_id", "left").withColumn("capture_id", F.coalesce("label", "record_id")).drop("label")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, ``request`` and ``response`` (or revisit) structs, ``metadata`` and ``others`` arrays of structs.

    Records are joined over concurrent-to identifiers, whichever of them names which. Of several requests or responses the
    smallest record id stands in front and the rest are in ``others``, as are records of other kinds; all metadata records are kept, by
    record id. What is missing is null or empty. A capture is one row, so all its records must fit one. Inside ``scratch`` the
    tables that this reads must last (they are written there).
    """
    columns = records.columns
    rows = transactions(records).withColumn("r", F.struct(*columns))
    all_ = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("r"))))
    kind = F.col("record_type")
    grouped = rows.groupBy("capture_id").agg(
        all_(kind == "request").alias("q"), all_(kind.isin("response", "revisit")).alias("a"), all_(kind == "metadata").alias("metadata"), all_(~kind.isin("request", "response", "revisit", "metadata")).alias("o")
    )
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    return grouped.select("capture_id", F.get("q", F.lit(0)).alias("request"), F.get("a", F.lit(0)).alias("response"), "metadata", F.concat(rest("q"), rest("a"), "o").alias("others"))


def roundtrip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages``, read the archives back, assemble the captures and resolve revisits by payload digest.

    Per page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    spark = pages.sparkSession
    with scratch(spark):
        if path is None:
            path = new_path(spark, "warc")
            note(path)
        return _read_back(spark, pages, path, id_col, url_col, payload_col)


def _read_back(spark: SparkSession, pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    write_warc(pages, path, id_col, url_col, payload_col)
    captures = assemble(read_warc(spark, path, blocks=False)).where("response is not null")
    field = lambda name: F.nullif(F.regexp_extract(F.get("metadata", F.lit(0))["block"].cast("string"), rf"(?m)^{name}: (-?\d*)", 1), F.lit("")).cast("long")
    rows = materialise(
        captures.select(
            field("pageId").alias("page_id"), field("refersToPageId").alias("refers_to"), F.col("response.record_type").alias("record_type"),
            F.col("response.payload_bytes").alias("n"), F.col("response.payload_sha1").alias("sha1"), F.regexp_replace("response.digest", "^sha1:", "").alias("digest"),
        ),
        "warc-captures", keep=True,
    )
    whole = rows.where("record_type = 'response'").groupBy(F.col("sha1").alias("digest")).agg(F.max("n").alias("whole"))
    revisits = rows.where("record_type = 'revisit'").join(whole, "digest", "left")
    columns = lambda n, d, r: (F.col("page_id").alias(id_col), n.alias("payload_bytes"), d.alias("payload_digest"), "record_type", r.alias("refers_to"))
    return rows.where("record_type = 'response'").select(*columns(F.col("n"), F.col("sha1"), F.lit(None).cast("long"))).unionByName(
        revisits.select(*columns(F.col("whole"), F.col("digest"), F.col("refers_to")))
    )
