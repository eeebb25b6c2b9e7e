"""WARC archives: written with Spark's text sink, read as binary files, assembled into one nested row a capture."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_path, dropped, pinned, scratch_path

END = "\r\n\r\n"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Records of one file (three a page) with payloads of up to LARGE bytes, and with larger ones. A task reads one record after another.
FILE_RECORDS = 3000
LARGE = 256 << 10
LARGE_RECORDS = 30
#: Captures made at a time of pages rows that are equal in page_id, url and html.
COPIES = 4096
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


#: A gzip member without content, the level of the others, and bytes of a member up to which it is unpacked at once.
EMPTY = gzip.compress(b"", mtime=0)
LEVEL = 4
AT_ONCE = 8 << 20


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end = END.encode()
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        for a in range(0, len(texts), 256):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(t + end, LEVEL, 31) for t in texts.slice(a, 256).to_pylist()], type=pa.binary())], names=["value"])


def _uuid(kind: str, key: Column) -> Column:
    """A record identifier made of a hash, so that reruns of a task write the same records."""
    h = F.md5(F.concat_ws("|", F.lit(kind), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, date: str, content_type: str, block: Column, more: list[tuple[str, Column]]) -> Column:
    """A record without its end; header fields with null values are left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields]), F.lit(END), block)


#: What may not stand in a line of application/warc-fields, percent-encoded.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def escaped(value: Column) -> Column:
    for plain, code in ESCAPES:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescaped(value: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def roles(pages: DataFrame) -> DataFrame:
    """page_id, link, digest, bytes, n (rows equal in these), keeper, keeper_link: the row whose response holds the payload (null: this one).

    ``link`` tells urls, null among them, apart. Of equal payloads (by SHA-1) of LEAST_REVISIT bytes or more the largest
    page_id keeps it; each row of that page_id does, and others refer to the one with the largest link. Only digests and links
    are shuffled; a digest of very many pages is counted with map-side combine, and its join is split by the adaptive skew join.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pinned(pages.select("page_id", "link", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes")).groupBy("page_id", "link", "digest", "bytes").agg(F.count("*").alias("n")), "warc-digests")
    best = pinned(rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", "link")).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "warc-best")
    joined = rows.join(best, "digest", "left")
    # the result is written, so that what it was made of can go
    other = ~F.col("best.page_id").eqNullSafe(F.col("page_id"))
    out = pinned(joined.select("page_id", "link", "digest", "bytes", "n", F.when(other, F.col("best.page_id")).alias("keeper"), F.when(other, F.col("best.link")).alias("keeper_link")), "warc-roles")
    dropped(rows, best)
    return out


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a request, a response or revisit, and a metadata record of each page (page_id, url, html) to files under ``path``.

    Null html is the empty payload; a null url is empty; line breaks in urls are dropped, those in page_ids of text are
    percent-encoded and come back. Every row is a capture of its own,
    rows equal in page_id, url and html too: their identifiers hold a number, and very many of them are made in blocks that
    are dealt to all tasks. Pages with large payloads go to files of fewer records, so a file is bounded by bytes. An empty
    table gives files without records; other columns are ignored. With "gzip" each record is a member of its own; other
    codecs compress files as a whole.
    """
    payload = F.coalesce("html", F.lit(""))
    link = F.coalesce(F.concat(F.lit("="), "url"), F.lit(""))
    pages = pages.select(F.col("page_id").alias("pid"), link.alias("to"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("uri"), payload.alias("body"), F.sha1(payload.cast("binary")).alias("dig"))
    r = roles(pages.select(F.col("pid").alias("page_id"), F.col("to").alias("link"), F.col("body").alias("html")))
    joined = pages.join(r, F.col("pid").eqNullSafe(F.col("page_id")) & (F.col("to") == F.col("link")) & (F.col("dig") == F.col("digest")))
    cols = ["pid", "to", "uri", "body", "dig", "bytes", "keeper", "keeper_link"]
    rows = joined.where("n = 1").select(*cols, F.lit(0).cast("long").alias("copy"))
    if r.where("n > 1").head(1):
        # map-side, one row of each task and set of equal rows is left; their captures are numbered again below
        same = joined.where("n > 1").groupBy("pid", "to", "dig").agg(F.first(F.struct("uri", "body", "bytes", "keeper", "keeper_link", "n")).alias("r")).select("pid", "to", "dig", "r.*")
        blocks = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("pid", "to", "dig", "block")
        rows = rows.union(blocks.select(*cols, F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)).alias("copy")))
    key = lambda page, link, copy: F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.col("dig"), link, F.when(copy > 0, copy.cast("string")))
    own, keeper = key(F.col("pid"), F.col("to"), F.col("copy")), key(F.col("keeper"), F.col("keeper_link"), F.lit(0))
    rid = _uuid("response", own)
    revisit = F.col("keeper").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    digest = F.concat(F.lit("sha1:"), F.col("dig"))
    response = _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), rid, F.col("uri"), date, "application/http;msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("body"))), [("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, _uuid("response", keeper))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))])
    request = _record(F.lit("request"), _uuid("request", own), F.col("uri"), date, "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1" + END)), [("WARC-Concurrent-To", rid)])
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), escaped(F.col("pid").cast("string")), F.lit("\r\n")), F.lit("")), F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), _uuid("metadata", own), F.col("uri"), date, "application/warc-fields", fields, [("WARC-Concurrent-To", rid)])
    large = r.where(F.col("bytes") > LARGE).head(1)
    for some, most in [(rows.where(F.col("bytes") <= LARGE) if large else rows, FILE_RECORDS), *([(rows.where(F.col("bytes") > LARGE), LARGE_RECORDS)] if large else [])]:
        records = some.select(F.explode(F.array(request, response, metadata)).alias("value"))
        if compression == "gzip":
            # a gzip member for each record, so that readers can seek; the sink's separator is an empty member
            packed = records.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
            packed.write.mode("append").option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(path)
        else:
            records.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).option("compression", compression).text(path)
    dropped(r)


def parse_file(raw: bytes) -> Iterator[dict]:
    """Records of one archive in memory, packed or not.

    Members between the separators that write() puts are unpacked one by one. Where one is large, holds several or does not
    end there, the rest is read as any gzip stream.
    """
    if raw[:2] != b"\x1f\x8b":
        yield from parse_stream(io.BytesIO(raw))
        return
    at, view = 0, memoryview(raw)
    while at < len(raw):
        stop = raw.find(EMPTY, at)
        stop = len(raw) if stop < 0 else stop
        if stop > at:
            d = zlib.decompressobj(31)
            try:
                text = d.decompress(view[at:stop]) if stop - at <= AT_ONCE else None
            except zlib.error:
                text = None
            if text is None or not d.eof or d.unused_data:
                yield from parse_stream(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(view[at:])), 1 << 20))
                return
            yield from parse_stream(io.BytesIO(text))
        at = stop + len(EMPTY)


def parse_stream(f) -> Iterator[dict]:
    """Records of one archive, by their Content-Length, one after another."""
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := f.readline()) != b"\r\n":
            if not line:
                raise ValueError("a header is cut off")
            k, v = line[:-2].split(b": ", 1)
            head[k] = v
        get = lambda k, h=head: h[k].decode() if k in h else None
        n = int(head[b"Content-Length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("a record is cut off")
        kind = get(b"WARC-Type")
        fields = {}
        payload = None
        if kind == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
        elif kind == "response":
            payload = block[block.find(b"\r\n\r\n") + 4 :]
        digest = (get(b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {get(b'WARC-Record-ID')} does not match its digest")
        yield {"record_id": get(b"WARC-Record-ID"), "type": kind, "concurrent_to": get(b"WARC-Concurrent-To"), "refers_to": get(b"WARC-Refers-To"), "uri": get(b"WARC-Target-URI"), "payload_digest": digest, "payload_bytes": None if payload is None else len(payload), "fields": list(fields.items()), "payload": payload}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``; without ``payloads`` the bodies are checked and measured but not returned."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(RECORD)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for r in parse_file(batch.column(0)[i].as_py()):
                    held += len(r["payload"] or b"")
                    rows.append(r if payloads else r | {"payload": None})
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def captures(records: DataFrame, id_type: str = "long") -> DataFrame:
    """One nested row a capture: page_id, url, response, request, metadata, refers_to_page.

    Requests and metadata meet their response through concurrent-to identifiers, revisits the page they refer to through
    its record identifier. Identifiers are near-unique, so the joins are even; very many revisits of one response are split
    by the adaptive skew join. Records read twice are one. page_id is read as ``id_type``. A response without request or metadata has nulls there.
    No records give no rows. ``records`` is read three times; round_trip() writes the heads once for that.
    """
    first = [c for c in records.columns if c != "record_id"]
    main = records.where(F.col("type").isin("response", "revisit"))
    side = lambda t, *cols: records.where(F.col("type") == t).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(*cols)).alias(t))
    meta = side("metadata", "record_id", unescaped(F.col("fields")["page-id"]).cast(id_type).alias("page_id"), F.col("fields")["payload-length"].cast("long").alias("payload_bytes"))
    one = main.groupBy("record_id").agg(F.first(F.struct(*first)).alias("response"))
    whole = one.join(meta, "record_id", "left").join(side("request", "record_id", "uri"), "record_id", "left")
    whole = pinned(whole, "warc-captures")
    names = whole.where(F.col("response.type") == "response").select(F.col("record_id").alias("target"), F.col("metadata.page_id").alias("refers_to_page"))
    out = whole.join(names, F.col("response.refers_to") == F.col("target"), "left")
    return out.select(F.col("metadata.page_id").alias("page_id"), F.col("response.uri").alias("url"), "record_id", "response", "request", "metadata", "refers_to_page")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """captures() of archives of ``pages``: one row of each row of ``pages``, repeated ones too.

    The archives are written to the shared folder and deleted when all captures are assembled and written there.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    records = read(spark, path, payloads)
    if not payloads:
        # every archive is unpacked and checked once; the heads are small
        records = pinned(records, "warc-heads")
    out = captures(records, dict(pages.dtypes)["page_id"])
    drop_path(spark, path)
    dropped(records)
    return out


SQL = """with p as (select page_id, sha1(coalesce(html, '')) d, octet_length(encode(coalesce(html, ''))) n from pages),
b as (select *, case when n >= 1000 then max(page_id) over (partition by d) else page_id end best from p)
select page_id, n::bigint payload_bytes, d payload_digest, case when best = page_id then 'response' else 'revisit' end record_type, case when best = page_id then null else best end refers_to from b"""
