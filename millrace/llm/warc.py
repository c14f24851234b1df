"""WARC writing, gzip normalising and reading.

Pages become WARC 1.1 records. Spark's text sink writes them through its committer on any Hadoop file system,
each file as one whole-file gzip stream (the monolithic form). The normaliser inflates such a stream once, piece
by piece, rewrites every record as a gzip member of its own, and writes a sidecar index of offsets beside it.
The reader opens members one by one; with the index it can open any record alone.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import release, ship
from millrace.llm.scratch import fresh_path, stage

MIN_REVISIT = 1000
#: Records of a file by their size: up to so many bytes, so many records. So a file fits in a task's memory; a record
#: larger than all has a file of its own.
FILE_RECORDS, BROADCAST_ROWS = ((1 << 15, 2_000), (1 << 20, 64), (None, 1)), 100_000
RECORD_END = "\r\n\r\n"
#: An empty gzip member; Spark's text sink puts it after the archive, and readers see nothing of it.
_EMPTY = gzip.compress(b"", mtime=0)
MEMBER_SCHEMA = "archive string, offset bigint, length bigint, page_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"


def decide(pages: DataFrame, id_col: str, payload, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with _b (bytes), _d (SHA-1), _to: the page whose response this one revisits, or null.

    Payloads are grouped by digest with a partial aggregation, and only digests that occur twice are joined
    back: by broadcast if they are few, else by a shuffle that adaptive execution may split.
    """
    rows = pages.withColumn("_p", payload).withColumn("_b", F.octet_length("_p").cast("bigint")).withColumn("_d", F.sha1("_p"))
    groups = stage(rows.where(F.col("_b") >= min_bytes).groupBy("_d").agg(F.max(id_col).alias("_m"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d", "_m"), "warc-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(groups) if few else groups, "_d", "left")
    return joined.withColumn("_to", F.when((F.col("_b") >= min_bytes) & ~F.col(id_col).eqNullSafe(F.col("_m")), F.col("_m"))).drop("_m")


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """One column ``value``: the record of each page without its final CR LF CR LF."""
    src = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))
    rows = decide(src, "i", F.col("h").cast("binary"), min_bytes)
    nl = F.lit("\r\n")
    # ids are put in URL form, so that any string can stand in a header; a null id is the bare name
    name = lambda c: F.concat(F.lit("<urn:millrace:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(c.cast("string"))), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce(F.col("u"), F.lit("")), r"[\x00-\x20\x7f]", "")
    revisit = F.col("_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("h"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_b").cast("string"), nl, nl)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), name(F.col("i")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"), F.when(url != "", F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_d"), F.lit("\r\nX-Payload-Length: "), F.col("_b").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), nl, nl,
    )
    return rows.select(F.concat(head, http, body).alias("value"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """Each file one gzip stream over many records; records are parted by size, and written class by class."""
    size, low = F.octet_length("value"), 0
    counts = [F.count(F.when((size >= lo) & (size < (hi or 1 << 40)), 1)) for lo, hi in zip([0, *[b for b, _ in FILE_RECORDS]], [b for b, _ in FILE_RECORDS])]
    found = records.agg(*counts).first()
    classes = [k for k, n in enumerate(found) if n] or [0]
    for k in classes:
        high, most = FILE_RECORDS[k]
        low = FILE_RECORDS[k - 1][0] if k else 0
        part = records if len(classes) == 1 else records.where((size >= low) & (size < (high or 1 << 40)))
        part.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0], **{k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}}


def split_records(chunks):
    """(head, block) of each record in a stream of inflated chunks; holds one record at a time.

    Raises ValueError on a broken header or a cut-off block.
    """
    buf = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while buf[:2] == b"\r\n" or not buf and fill(1):
            if buf[:1] not in (b"\r", b"\n"):
                break
            fill(2)
            del buf[:2]
        if not buf:
            return
        seek = 0
        while (at := buf.find(b"\r\n\r\n", seek)) < 0:
            seek = max(0, len(buf) - 3)
            if not fill(len(buf) + 1):
                raise ValueError("a record's header is cut off")
        head = bytes(buf[:at])
        size = headers(head).get("content-length", "")
        if not head.startswith(b"WARC/") or not size.isdigit():
            raise ValueError("not a WARC record")
        if not fill(at + 4 + int(size)):
            raise ValueError("a record's block is cut off")
        yield head, bytes(buf[at + 4 : at + 4 + int(size)])
        del buf[: at + 4 + int(size)]
        if fill(4) and buf[:4] == b"\r\n\r\n":
            del buf[:4]


def inflate(data, step: int = 1 << 18):
    """Inflated chunks of a gzip file of one or more members, or of a file that isn't compressed."""
    data = memoryview(data).cast("B")
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(data[i : i + step]) for i in range(0, len(data), step))
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            fed = data[at : at + step]
            at += len(fed)
            got = z.decompress(fed, step)
            if not fed and not got and not z.eof:
                raise ValueError("a gzip stream is cut off")
            yield got
            while z.unconsumed_tail and not z.eof:
                yield z.decompress(z.unconsumed_tail, step)
        at -= len(z.unused_data)
        while at < len(data) and data[at] == 0:  # padding
            at += 1


def member(data: bytes, at: int, step: int = 1 << 18) -> tuple[bytes, int]:
    """(content, length in the file) of the gzip member at an offset."""
    z, out, i = zlib.decompressobj(31), [], at
    while not z.eof:
        if i >= len(data):
            raise ValueError("a gzip member is cut off")
        out.append(z.decompress(data[i : i + step]))
        i = min(len(data), i + step)
    return b"".join(out), i - at - len(z.unused_data)


def describe(head: bytes, block: bytes) -> dict:
    """What the index says of a record; digest and length of a response come from its payload itself."""
    h = headers(head)
    bare = lambda s: None if s is None or s == "<urn:millrace:page>" else unquote_plus(s.removeprefix("<urn:millrace:page:").removesuffix(">"))
    kind = h.get("warc-type", "")
    out = {"page_id": bare(h.get("warc-record-id")), "record_type": kind, "refers_to": bare(h.get("warc-refers-to"))}
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        return out | {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
    return out | {"payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(h.get("x-payload-length", 0))}


def normalise_bytes(data) -> tuple[bytes, list[dict]]:
    """(archive with one member per record, index entries) of a monolithic archive."""
    out, index = bytearray(), []
    for head, block in split_records(inflate(data)):
        member = gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
        index.append({"offset": len(out), "length": len(member), **describe(head, block)})
        out += member
    return bytes(out), index


def normalise(spark, source: str, target: str) -> None:
    """Rewrite every archive under ``source`` into ``target``: ``archive=<name>/kind=warc`` and ``kind=index``.

    One task per source file; the committer publishes an archive and its index together with all the others.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                body, index = normalise_bytes(data.as_buffer())
                side = gzip.compress("".join(json.dumps(x) + "\n" for x in index).encode(), mtime=0)
                name = hashlib.sha1(path.rsplit("/", 1)[-1].encode()).hexdigest()[:20]
                yield pa.RecordBatch.from_arrays([pa.array([name] * 2), pa.array(["warc", "index"]), pa.array([body, side], pa.binary())], names=["archive", "kind", "value"])
                del body, index, side
            release()

    files = spark.read.format("binaryFile").load(source).select("path", "content")
    out = files.mapInArrow(run, "archive string, kind string, value binary")
    raw = out.withColumn("value", F.col("value").cast("string"))  # a cast keeps the bytes as they are, and the sink writes them
    raw.write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").partitionBy("archive", "kind").text(target)


def read_archives(spark, path: str) -> DataFrame:
    """The records of normalised archives, member by member, as MEMBER_SCHEMA: offsets are those of the members."""
    ship(spark)
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("content")):
                data, at, rows = memoryview(data.as_buffer()).cast("B"), 0, []
                while at < len(data):
                    got, size = member(data, at)
                    rows += [{"archive": archive, "offset": at, "length": size, **describe(h, b)} for h, b in split_records([got] if got else [])]
                    at += size
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
            release()

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, archive string, kind string").load(path)
    return files.where("kind = 'warc'").select("archive", "content").mapInArrow(run, MEMBER_SCHEMA)


def read_index(spark, path: str) -> DataFrame:
    """The sidecar indexes, as MEMBER_SCHEMA."""
    fields = T._parse_datatype_string(MEMBER_SCHEMA)
    lines = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, archive string, kind string").load(path).where("kind = 'index'")

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("content")):
                rows = [{"archive": archive, **json.loads(x)} for x in b"".join(inflate(data.as_buffer())).splitlines()]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in fields]))

    return lines.select("archive", "content").mapInArrow(run, MEMBER_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` as WARC, normalise, read back: id, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest id is the response and the
    others revisit it; null ids come before all others. Repeated rows with the largest id are all responses.
    Null html: empty payload. Null url: no target URI; control characters and spaces of a URL are left out.
    Ids may be of any type that strings can be cast to. Null id: a record without one, null in the result. Empty table:
    no records. Other columns are not read.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    whole, members = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc-members")
    write_monolithic(to_records(pages, id_col, url_col, html_col, min_bytes), whole)
    normalise(spark, whole, members)
    got = read_archives(spark, members)
    as_id = lambda c: F.col(c).cast(kind)
    return got.select(as_id("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS m FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to
FROM g
"""
