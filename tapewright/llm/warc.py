"""WARC: pages written as (possibly segmented) records, and archives read back with their segments reassembled."""

from __future__ import annotations

import base64
import gzip
import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh_path, saved

#: Bytes of a record's block; longer ones go on in continuation records.
SEGMENT = 16 << 10
#: Bytes of a chunk of the chunked transfer coding.
CHUNK = 4 << 10
#: Records of a file at most.
FILE_RECORDS = 2_000
#: Revisits that are broadcast to the writers at most (a row is under 100 bytes in memory); more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PARSED = "origin string, segment int, total long, record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, block binary"
READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _cuts(data: bytes, size: int):
    """Parts of about ``size`` bytes that end between characters."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + size)
        while end < len(data) and end > begin + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[begin:end]
        begin = end


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%X\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, CHUNK)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at += size + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: dict, block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def _record_id(page_id: int | None, payload_digest: str, unique: int | None) -> str:
    """A page's record by its id and payload; of repeated rows all but one have a number behind."""
    return f"<urn:page:{'' if page_id is None else page_id}:{payload_digest}{'' if unique is None else f':{unique}'}>"


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, unique: int | None = None) -> list[str]:
    """The records of a page, without the blank lines that end each. ``unique``: see _record_id()."""
    payload = (html or "").encode()
    said = digest(payload)
    rid = _record_id(page_id, said, unique)
    common = {
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]-._ ").replace(" ", "%20"),
        "WARC-Payload-Digest": "sha1:" + said,
        "Content-Type": "application/http;msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Identity-Length: {len(payload)}\r\n".encode()
    if refers_to is not None:
        more = {"WARC-Refers-To": _record_id(refers_to, said, None), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_record({"WARC-Type": "revisit", "WARC-Record-ID": rid} | common | more, http + b"\r\n")]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(_cuts(block, SEGMENT))
    if len(parts) == 1:
        return [_record({"WARC-Type": "response", "WARC-Record-ID": rid} | common, block)]
    out = [_record({"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Segment-Number": 1} | common, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"{rid[:-1]}.{k}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total}, part))
    return out


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id and refers_to of the pages whose payload, of ``least`` bytes or more, a page with a smaller id also has."""
    text = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.encode(text, "UTF-8")).alias("sha"), F.octet_length(text).alias("size")).where(F.col("size") >= least)
    keys = saved(keys, "warc-keys")
    first = keys.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(first, ["sha", "size"]).where("refers_to < page_id OR (page_id IS NULL AND refers_to IS NOT NULL)")
    return again.select("page_id", "refers_to", "sha").distinct()


def _numbered(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with ``unique``: null, but a number for all but one of the rows that have the same
    page_id and html. Only such rows are shuffled; the page they share may be any part of the table."""
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    key = F.struct("page_id", sha.alias("sha"))
    several = saved(pages.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"), "warc-repeats")
    none = F.lit(None).cast("long").alias("unique")
    if several.isEmpty():
        return pages.select("*", none)
    small = several.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    hint = F.broadcast if small else (lambda x: x)
    rows = saved(pages.join(hint(several), key == F.col("key")).withColumn("number", F.monotonically_increasing_id()), "warc-numbered")
    first = rows.groupBy(F.col("key").alias("k")).agg(F.min("number").alias("first"))
    numbered = rows.join(hint(first), F.col("key") == F.col("k")).select("page_id", "url", "html", F.when(F.col("number") != F.col("first"), F.col("number")).alias("unique"))
    return pages.join(hint(several), key == F.col("key"), "left_anti").select("*", none).unionByName(numbered)


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files under ``path``, by Spark's own committer.

    Of pages with equal payloads of ``least`` bytes or more that with the smallest page_id is a response and the
    others are revisits of it. Null html: an empty payload; null page_id: never the one referred to if another has
    one; repeated rows are written each."""
    known = saved(revisits(pages, least), "warc-revisits")
    small = known.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    p = _numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    k = known.select(F.col("page_id").alias("k_id"), "refers_to", F.col("sha").alias("k_sha"))
    same = p["page_id"].eqNullSafe(k["k_id"]) & (F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")) == k["k_sha"])
    p = p.join(F.broadcast(k) if small else k, same, "left").select("page_id", "url", "html", "refers_to", "unique")

    def run(batches):
        for batch in batches:
            out: list[str] = []
            for begin in range(0, batch.num_rows, 200):
                for r in batch.slice(begin, 200).to_pylist():
                    out += records(r["page_id"], r["url"], r["html"], r["refers_to"], r["unique"])
                yield pa.record_batch({"value": pa.array(out, pa.string())})
                out = []

    p.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    forget(known)


def parse(data: bytes):
    """Records (headers, block) of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        at = head + 4
        size = int(headers["Content-Length"])
        block = data[at : at + size]
        if len(block) != size or data[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block
        at += size + 4


def _page_id(rid: str) -> int | None:
    number = rid.strip("<>").split(":")[2]
    return int(number) if number else None


def _complete(headers: dict, block: bytes) -> tuple[int, str, bytes | None]:
    """Payload bytes, digest and payload of a whole record; those of a revisit are what its headers say."""
    head = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:head].decode().split("\r\n")[1:])
    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "revisit":
        return int(http["X-Identity-Length"]), said, None
    payload = unchunked(block[head + 4 :])
    if digest(payload) != said:
        raise ValueError("a payload has another digest than its record says")
    return len(payload), said, payload


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The responses and revisits of the archives under ``path``: page_id, uri, payload_bytes, payload_digest,
    record_type, refers_to and, if asked, payload (null for revisits).

    Segments are grouped by their origin's identifier and put in order of their numbers; a missing one, or a total
    length that differs, is an error. A group is no larger than its record."""
    schema = READ + (", payload binary" if payload else "")

    def done(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in schema.split(", ")]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    fields = [x.split() for x in PARSED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def split(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in parse(gzip.decompress(data.as_py())):
                    number = h.get("WARC-Segment-Number")
                    uri, refers = h.get("WARC-Target-URI"), h.get("WARC-Refers-To")
                    origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
                    total = h.get("WARC-Segment-Total-Length")
                    said = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    row = [origin, int(number or 0), int(total) if total else None, h["WARC-Type"], _page_id(origin), uri, _page_id(refers) if refers else None, None, said, block]
                    if not number:
                        size, said, body = _complete(h, block)
                        row[7:] = [size, said, body if payload else None]
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def join(batches):
        held: list[dict] = []

        def whole():
            first, last = held[0], held[-1]
            block = b"".join(r["block"] for r in held)
            if [r["segment"] for r in held] != list(range(1, len(held) + 1)) or last["total"] != len(block):
                raise ValueError(f"record {first['origin']} is not whole")
            size, said, body = _complete({"WARC-Type": first["record_type"], "WARC-Payload-Digest": first["payload_digest"]}, block)
            return (first["page_id"], first["uri"], size, said, first["record_type"], None) + ((body,) if payload else ())

        out = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                for r in batch.slice(begin, 500).to_pylist():
                    if held and held[0]["origin"] != r["origin"]:
                        out.append(whole())
                        held.clear()
                    if r["segment"]:
                        held.append(r)
                    else:
                        out.append((r["page_id"], r["uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) + ((r["block"],) if payload else ()))
                yield done(out)
                out = []
        if held:
            yield done([whole()])

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(split, PARSED)
    return parsed.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(join, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back (without payloads). An empty table writes
    archives without records and gives an empty table; further columns of pages are ignored, whatever their names. A payload
    of any length is written whole, in segments; nulls and repeated rows are treated as write_warc() says."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, least)
    return read_warc(spark, path, payload=False)
