"""WARC archives: segmented, chunked records written, parsed and reassembled.

The writer gives one record for each row. A response's HTTP block is sent in
chunks; a block beyond segment_bytes goes on in continuation records. The
reader parses whole archives, groups continuations by the origin's identifier,
orders them by segment number, verifies the total length and decodes the
chunked framing. Of equal payloads one row is the response; the others are
revisit records without a payload.

Archives are gzip files of at most file_bytes bytes of records (or one row's) in the
shared folder; a row's records are in one file.
The reader streams each of them; besides the compressed file a task holds one
record's segments. Records in one piece are not shuffled.

Defined results: a null payload is empty; null or repeated ids are kept, rows
alike in id, uri and payload give the same record as often as they occur; of
equal payloads the largest id (then the largest content hash) is the response,
and rows without an id come last; an empty table gives no records. A record
whose segments are missing, out of number or of wrong total length comes back
with intact false, the reason and a null payload; one that is damaged in another
way (see read()) with the reason and what there is of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FIELDS = "record_id string, type string, uri string, refers_to string, digest string, payload binary, payload_length long, intact boolean, reason string"


def base32(hexed: Column) -> Column:
    """Base32 of 40 hex digits, without padding (none is due)."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts.append(b"%x\r\n%s\r\n" % (len(part), part))
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """A body without its chunks' framing. ValueError: it is none, or doesn't end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        line = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", line):
            raise ValueError("no size of a chunk")
        size, at = int(line, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the two line ends after it, which the text writer adds."""
    head = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one row."""
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = RESPONSE_HEAD + chunked(payload, chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    if len(cuts) == 1:
        yield record([("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")], block)
        return
    for n, i in enumerate(cuts, 1):
        total = len(block) if n == len(cuts) else None
        if n == 1:
            yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), ("Content-Type", "application/http;msgtype=response")], block[:segment_bytes])
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Total-Length", total)], block[i : i + segment_bytes])


def write(rows: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", segment_bytes: int = 8192, chunk_bytes: int = 4096, file_bytes: int = 128 << 20) -> None:
    """Archives of rows (record_id, uri, payload, digest, refers_to) under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("record_id", "uri", "payload", "digest", "refers_to")]
            out, files = [], []
            for i, u, p, d, t in zip(*cols):
                own = list(records(i, u, p or b"", d, t, date, segment_bytes, chunk_bytes))
                if size and size + sum(map(len, own)) > file_bytes:
                    file, size = file + 1, 0
                size += sum(map(len, own))
                out += own
                files += [file] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], ["record", "file"])

    # The text writer puts any bytes as they are; its line end is the one that ends a record.
    lines = rows.select("record_id", "uri", F.col("payload").cast("binary"), "digest", "refers_to").mapInArrow(run, "record binary, file int")
    lines.select(F.col("record").cast("string"), "file").write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a plain or gzip archive, one or more members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    z = zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + step]
        at += len(part)
        yield z.decompress(part)
        while z.eof and (z.unused_data or at < len(view)):
            rest, z = z.unused_data, zlib.decompressobj(31)
            if not rest:
                break
            yield z.decompress(rest)
    if not z.eof:
        raise ValueError("archive ends within a member")


NUMBER = re.compile(r"[0-9]{1,18}")
#: What every record must have.
NEEDED = ("warc-type", "warc-record-id", "content-length")
#: The longest head of a record that is looked for.
HEAD_BYTES = 1 << 20


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields with lower-case names, block, what is wrong with it or None) of each record.

    After what is no record, reading goes on at the next line that begins one; an archive that is
    cut off or can't be inflated further gives what it has before that.
    """
    data, buffer, at, damaged = inflated(content), bytearray(), 0, None

    def upto(n: int) -> bool:
        nonlocal damaged
        while len(buffer) - at < n:
            try:
                more = next(data, None)
            except (zlib.error, ValueError) as e:
                damaged, more = f"archive: {e}", None
            if more is None:
                return False
            buffer.extend(more)
        return True

    def following(start: int) -> int:
        """Where the next record begins; the buffer's end if nowhere."""
        seen = start
        while (n := buffer.find(b"\nWARC/1.", seen)) < 0:
            seen = max(start, len(buffer) - 8)
            if not upto(len(buffer) - at + 1):
                return len(buffer)
        return n + 1

    while True:
        while upto(2) and buffer[at : at + 2] == b"\r\n":  # blank lines between records
            at += 2
        end = -1
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 and len(buffer) - at < HEAD_BYTES and upto(len(buffer) - at + 1):
            pass
        if not buffer[at:].strip():
            if damaged:
                yield {}, b"", damaged
            return
        lines = bytes(buffer[at : max(end, at)]).decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            stop = following(at)
            yield {}, bytes(buffer[at:stop]), damaged if damaged and stop == len(buffer) else "no record begins here"
            at = stop
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        lacking = [f for f in NEEDED if not fields.get(f)]
        if "content-length" in lacking or not NUMBER.fullmatch(fields["content-length"]):
            stop = following(at)
            yield fields, bytes(buffer[at:stop]), f"without {lacking[0]}" if lacking else "length of block"
            at = stop
            continue
        size = int(fields["content-length"])
        upto(size + 4)
        block, wrong = bytes(buffer[at : at + size]), f"without {lacking[0]}" if lacking else None
        if len(block) < size:
            wrong = damaged or "archive ends within a block"
        elif buffer[at + size : at + size + 4] not in (b"\r\n\r\n", b"\r\n", b""):
            wrong = wrong or "length of block"
            size = following(at) - at
        yield fields, block, wrong
        at = min(at + size, len(buffer))
        if at > 1 << 20:
            del buffer[:at]
            at = 0


def payload(block: bytes) -> tuple[bytes, int | None, str | None]:
    """An HTTP block's payload without its transfer framing, its declared length, and what is wrong. A
    body that isn't framed as its fields say is given as it is."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    wrong = None
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower():
        try:
            body = unchunked(body)
        except ValueError as e:
            wrong = f"framing: {e}"
    length = fields.get(b"content-length")
    if length is not None and not NUMBER.fullmatch(length.decode("latin-1")):
        length, wrong = None, wrong or "length of payload"
    return body, length if length is None else int(length), wrong


def _bare(x: str | None) -> str | None:
    return x and x.strip("<>")


def _whole(fields: dict, block: bytes | None, wrong: str | None) -> tuple:
    """A row of FIELDS; block None: it could not be put together."""
    kind = fields.get("warc-type")
    body, declared, bad = (None, None, None) if block is None else payload(block)
    if not fields:
        body, bad = block, None
    if kind == "revisit":
        body, length = None, declared
    else:
        length = None if body is None else len(body)
    wrong = wrong or bad
    return _bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, body, length, wrong is None, wrong


def _segment(fields: dict[str, str]) -> bool:
    """Whether a record is one of a row of segments that can be put together."""
    return bool(NUMBER.fullmatch(fields.get("warc-segment-number", ""))) and len(fields["warc-segment-number"]) < 10 and NUMBER.fullmatch(fields.get("warc-segment-total-length", "0")) is not None and bool(fields.get("warc-segment-origin-id", fields.get("warc-record-id")))


def _alone(fields: dict[str, str], wrong: str | None) -> bool:
    """Whether a record is a row by itself: a response or revisit, or one that can't be read."""
    return not _segment(fields) and (wrong is not None or fields["warc-type"] in ("response", "revisit", "continuation") or "warc-segment-number" in fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


WHOLE = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("intact", pa.bool_()), ("reason", pa.string())])
PART = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _flush(rows: Iterator[tuple], schema: pa.Schema, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes in column at."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[at] or b"")
        if size > limit:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All response and revisit records of the archives under path, and what can't be read as a record: FIELDS.

    A damaged record has intact = false and the reason: fields that lack or are no numbers, a block that
    isn't as long as it says, an archive that is cut off or can't be inflated, framing that isn't there
    or doesn't end (the body is given as it is then), segments that lack or don't add up
    (payload null). Sound records beside it come back all the same.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for c in batch.column(0):
                    for f, b, wrong in parsed(c.as_py()):
                        if _alone(f, wrong):
                            stray = "segment's fields" if "warc-segment-number" in f or f.get("warc-type") == "continuation" else None
                            yield _whole(f, b, wrong or stray)

        yield from _flush(rows(), WHOLE, 5)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for c in batch.column(0):
                    for f, b, wrong in parsed(c.as_py()):
                        if _segment(f):
                            total = f.get("warc-segment-total-length")
                            yield _bare(f.get("warc-segment-origin-id", f.get("warc-record-id"))), int(f["warc-segment-number"]), total and int(total), None if "warc-segment-origin-id" in f else list(f.items()), None if wrong else b

        yield from _flush(rows(), PART, 4)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(group: list[dict]) -> Iterator[tuple]:
            copies = max(sum(g["number"] == 1 for g in group), 1)
            pieces = {g["number"]: g for g in group}
            head = pieces.get(1, {}).get("head")
            fields = dict(head) if head else {"warc-type": "response", "warc-record-id": group[0]["origin"]}
            block = b"".join(pieces[n]["block"] or b"" for n in sorted(pieces))
            good = head is not None and all(g["block"] is not None for g in pieces.values()) and sorted(pieces) == list(range(1, len(pieces) + 1)) and pieces[len(pieces)]["total"] == len(block)
            row = _whole(fields, block if good else None, None if good else "segments")
            yield from (row for _ in range(copies))

        def rows() -> Iterator[tuple]:
            group: list[dict] = []
            for batch in batches:
                for g in batch.to_pylist():
                    if group and group[0]["origin"] != g["origin"]:
                        yield from one(group)
                        group = []
                    group.append(g)
            if group:
                yield from one(group)

        yield from _flush(rows(), WHOLE, 5)

    segments = files.mapInArrow(parts, "origin string, number int, total long, head map<string,string>, block binary")
    joined = segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assembled, FIELDS)
    return files.mapInArrow(whole, FIELDS).unionByName(joined)


def id_of(record_id: Column, kind: str) -> Column:
    """The id, of an SQL type, in a record's name from with_revisits(); null if it has none."""
    part = F.split(record_id, ":")[2]
    return F.when(part.startswith("id="), F.try_url_decode(F.substring(part, 4, 1 << 30))).try_cast(kind)


def with_revisits(rows: DataFrame, id_col: str, uri: str, payload_col: str, scheme: str = "urn:page") -> DataFrame:
    """record_id, uri, payload, digest, refers_to: of rows with equal payloads
    that with the largest id is the response. Counting is pre-aggregated; the
    join back is on the digest, whose frequent values Spark splits."""
    base = rows.select(F.col(id_col).alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", base32(F.sha1("payload"))).withColumn("row", F.xxhash64("uri", "payload"))
    last = base.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"))
    name = lambda i, r: F.concat_ws(":", F.lit(scheme), F.coalesce(F.concat(F.lit("id="), F.url_encode(i.cast("string"))), F.lit("none")), F.lower(F.hex(r)))
    own, of = name(F.col("id"), F.col("row")), name(F.col("last.id"), F.col("last.row"))
    return base.join(last, "digest").select(own.alias("record_id"), "uri", "payload", "digest", F.when(own != of, of).alias("refers_to"))
