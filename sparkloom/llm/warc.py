"""WARC archives: writing with revisit records and segmentation, and reading with segment reassembly.

write() makes one record per page: a response, or a revisit of the response with the same payload. The block of a
response is an HTTP message whose payload has chunked transfer framing. Blocks over SEGMENT bytes are cut: the first
record has segment number 1, continuation records name it as their origin, and the last gives the total length. Each
record is a gzip member of its own, and a file begins with a warcinfo record. Records' ids follow from page and
payload, so that another run writes the same; a revisit names its response by that id.

read() parses the archives file by file, groups the records of one block by the identifier of the first, orders them
by segment number, verifies that none is missing and that the total length holds, decodes the framing and verifies
the payload's digest. A revisit is resolved by the record that it refers to.

A null html is an empty payload, a null url an empty target. Of equal payloads the response is the one of the largest
page id, nulls last; payloads under LEAST bytes are never revisits. Repeated rows of the response's id are responses
too; as no single one of them is the one referred to, their revisits name none and are resolved by the payload's
digest. An empty table gives empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, key_of, small

#: Smallest payload that is replaced by a revisit.
LEAST = 1000
#: Bytes of a record's block; longer ones are segmented.
SEGMENT = 16 << 10
CHUNK = 4 << 10
#: Records of one archive file; with SEGMENT this bounds what a reading task holds.
FILE_RECORDS = 2000
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i : i + CHUNK]), c) for i in range(0, len(payload), CHUNK)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, named: bool = True, place: str = "") -> Iterator[bytes]:
    """The records of a page, each without the blank lines that end it. refers_to: the page of the response that a
    revisit names, if it is named. place tells repeated rows apart."""
    digest = digest_of(payload)
    own = record_id(page_id, digest, place, "revisit") if revisit else record_id(page_id, digest, place)
    common = {"WARC-Record-ID": own, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Date": "1970-01-01T00:00:00Z"}
    page = {} if page_id is None else {"Page-ID": page_id}
    content = {"WARC-Payload-Digest": digest, "Content-Type": "application/http;msgtype=response"}
    if revisit:
        target = {"WARC-Refers-To": record_id(refers_to, digest, "")} if named else {}
        yield header({"WARC-Type": "revisit", **common, **page, **content, "WARC-Profile": PROFILE, **target}, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield header({"WARC-Type": "response", **common, **page, **content}, block)
        return
    for number, i in enumerate(range(0, len(block), SEGMENT), 1):
        if number == 1:
            fields = {"WARC-Type": "response", **common, **page, **content}
        else:
            fields = {"WARC-Type": "continuation", **common, "WARC-Record-ID": record_id(own, number), "WARC-Segment-Origin-ID": own}
        fields["WARC-Segment-Number"] = number
        if i + SEGMENT >= len(block):
            fields["WARC-Segment-Total-Length"] = len(block)
        yield header(fields, block[i : i + SEGMENT])


INFO = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gzip members of the records of (page_id, url, payload, refers_to, revisit, named, repeated), after every
    FILE_RECORDS - 1 of which a file ends."""
    part, made, row_ = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            out = []
            for *row, repeated in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                row_ += 1
                for r in records(*row, f"{part}.{row_}" if repeated else ""):
                    if made % FILE_RECORDS == 0:
                        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", part, made), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
                        out.append(header(fields, INFO))
                        made += 1
                    out.append(r)
                    made += 1
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r + END, 6, mtime=0) for r in out], pa.binary())], ["record"])


def write(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """pages (page_id, url, html) as gzipped archives in the folder path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "page_key": key_of(F.col("page_id"))})
    each = rows.groupBy("digest", "page_key", "page_id").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    each = scratch.write(each, "each")
    copies = each.where(F.col("size") >= LEAST).groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("m"), F.sum("n").alias("n")).where("n > 1")
    copies = copies.select("digest", F.col("m.page_id").alias("first"), (F.col("m.n") == 1).alias("named"))
    again = each.where("n > 1").select("digest", "page_key", F.lit(True).alias("repeated"))
    joined = rows.join(small(scratch.write(copies, "copies"), 100), "digest", "left").join(small(scratch.write(again, "again"), 100), ["digest", "page_key"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    flags = [F.col("first").alias("refers_to"), revisit.alias("revisit"), F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("repeated", F.lit(False)).alias("repeated")]
    framed = joined.select("page_id", "url", "payload", *flags).mapInArrow(_records, "record binary")
    # A string column may hold any bytes; the text writer passes them on, with a separator after each. It can't be
    # empty, so it is the gzip member of no bytes.
    nothing = gzip.compress(b"", mtime=0).decode("latin-1")
    framed.select(F.col("record").cast("string")).write.option("lineSep", nothing).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    scratch.drop("each", "again")


def unzipped(data: bytes) -> bytes:
    """The content of an archive of one gzip member, or one per record."""
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside of a gzip member")
            part = data[at : at + (1 << 15)]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = unzipped(data)
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != END:
            raise ValueError(f"record {fields.get('warc-record-id')} doesn't end where its length says")
        yield fields, block
        at = end + 8 + size


def payload_of(message: bytes) -> bytes:
    head, _, body = message.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


PARSED = "origin string, page_id long, type string, refers_to string, declared string, payload_bytes long, payload_digest string, number int, total long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in PARSED.split(", ")]
    for batch in batches:
        for data in batch.column(0):
            out = []
            for f, block in parse(data.as_py()):
                kind, whole = f["warc-type"], "warc-segment-number" not in f
                if kind not in ("response", "revisit", "continuation"):
                    continue
                size = digest = None
                if whole and kind == "response":
                    payload = payload_of(block)
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                first = kind != "continuation"
                origin = f["warc-record-id"] if first else f["warc-segment-origin-id"]
                total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                declared = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex() if first else None
                page = int(f["page-id"]) if first and "page-id" in f else None
                out.append((origin, page, kind if first else None, f.get("warc-refers-to"), declared, size, digest, None if whole else int(f["warc-segment-number"]), total, None if whole else block))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _reassembled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for segments in batch.to_pylist():
            if not segments:
                out.append(None)
                continue
            block = b"".join(s["block"] for s in segments)
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                raise ValueError(f"a segment is missing: numbers {[s['number'] for s in segments]}, total length {segments[-1]['total']}, found {len(block)}")
            payload = payload_of(block)
            out.append({"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()})
        yield pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))


def read(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each response and revisit."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(_parsed, PARSED)
    segment = F.when(F.col("block").isNotNull(), F.struct("number", "total", "block"))
    first = ["page_id", "type", "refers_to", "declared", "payload_bytes", "payload_digest"]
    blocks = parsed.groupBy("origin").agg(F.sort_array(F.collect_list(segment)).alias("segments"), *[F.max(c).alias(c) for c in first])
    done = blocks.withColumn("whole", F.arrow_udf(_reassembled, "struct<payload_bytes: long, payload_digest: string>")(F.col("segments"))).select(
        "origin", "page_id", "type", "refers_to", "declared", *[F.coalesce(c, f"whole.{c}").alias(c) for c in ("payload_bytes", "payload_digest")]
    )
    done = scratch.write(done, "records")
    responses, revisits = done.where("type = 'response'"), done.where("type = 'revisit'")
    sound = F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("wrong payload digest on page "), F.col("page_id").cast("string"))))
    responses = responses.withColumn("payload_digest", sound)
    revisits = revisits.select("page_id", "refers_to", "declared")
    named, loose = revisits.where("refers_to is not null"), revisits.where("refers_to is null")
    target = [F.col("page_id").alias("target"), "payload_bytes"]
    by_id = responses.join(named.select(F.col("refers_to").alias("origin")).distinct(), "origin", "left_semi").select(F.col("origin").alias("refers_to"), F.col("payload_digest").alias("declared"), *target)
    by_digest = responses.join(loose.select("declared").distinct(), "declared", "left_semi").groupBy(F.col("payload_digest").alias("declared")).agg(F.max(F.struct(*target)).alias("t")).select("declared", "t.target", "t.payload_bytes")
    columns = ["page_id", "declared", "target", "payload_bytes"]
    resolved = named.join(small(by_id, 150), ["refers_to", "declared"], "left").select(*columns).union(loose.join(small(by_digest, 100), "declared", "left").select(*columns))
    found = F.when(F.col("payload_bytes").isNotNull(), F.col("declared")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id").cast("string"))))
    columns = ["page_id", "payload_bytes", "payload_digest"]
    return responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        resolved.select("page_id", "payload_bytes", found.alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to"))
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the scratch folder and reads these back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = f"{scratch.folder}/archives"
    write(pages, path, scratch)
    out = read(pages.sparkSession, path, scratch)
    scratch.drop("archives", "copies")
    return out
