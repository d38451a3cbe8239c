"""A content-addressed WARC archive.

The archive is two tables. ``payloads`` holds every distinct payload once, as a
zstd frame under its SHA-256; ``records`` holds the exact bytes of every
record's headers (WARC and HTTP) and the digest of its payload. A join on the
digest gives the original records back; the payload that it brings is hashed
again and must have the digest and length that its record names.

Digests. When payloads are folded by digest, a second hash and the length of all
of them are compared; two payloads under one digest stop the job, as does a
payload that no longer has its digest when it is read.

Hot payloads. The record that others refer to is found by minima over (digest,
salt), then over the digest, and goes back to the salts that occur, so equal
payloads never meet in one task. A payload is stored with the number of its
records and sent to as many parts as there are thousands of them.

Defined results: a null payload is an empty one; a null id is the largest; of
wholly equal rows one counts as the first and the others repeat it; payloads
below ``least`` bytes are kept once too but their records are all of type
response; extra columns are ignored; an empty table gives an empty archive. CR
and LF in a URL are written as %0D and %0A, a null URL is left out. Record ids
are unique; they can differ between runs that split the input otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below so many bytes are not revisited.
LEAST = 100
#: Records that one copy of a payload serves in the join.
PER_PART = 1000
#: Salts over which records of one payload are spread to find their first.
SALTS = 256
#: Bytes of payload in an output batch.
_STEP = 8 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _frames(payload_col: str):
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for x in batch.column(payload_col).to_pylist():
                raw = x.encode() if isinstance(x, str) else bytes(x or b"")
                check = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                rows.append((hashlib.sha256(raw).digest(), check, len(raw), pack(raw)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["digest", "check", "n_bytes", "frame"])

    return run


def payload_store(pages: DataFrame, payload_col: str = "html") -> DataFrame:
    """``digest, n_bytes, parts, frame``: every distinct payload once."""
    each = pages.select(payload_col).mapInArrow(_frames(payload_col), "digest binary, check long, n_bytes long, frame binary")
    one = each.groupBy("digest").agg(F.first("frame").alias("frame"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("b1"), F.count(F.lit(1)).alias("n"))
    bad = (F.col("c0") != F.col("c1")) | (F.col("n_bytes") != F.col("b1"))
    frame = F.when(bad, F.raise_error(F.lit("two payloads have one digest")).cast("binary")).otherwise(F.col("frame"))
    return one.select("digest", "n_bytes", _parts(F.col("n")).alias("parts"), frame.alias("frame"))


def _parts(n: Column) -> Column:
    return F.ceil(n / PER_PART).cast("int")


def _record_id(key: Column, digest: Column, copy: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.hex(digest), F.to_json(key), copy.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``digest, part, header`` of every record: its bytes up to where the payload stands."""
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    row = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"), F.spark_partition_id().alias("split"))
    # Wholly equal rows of a split become one row with their number.
    rows = row.groupBy("id", "url", "digest", "n_bytes", "split").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", F.col("url").isNull().alias("no_url"), "url", "split")
    rows = rows.select("digest", "n_bytes", "n", key.alias("key"), F.pmod(F.xxhash64("id", "url", "split"), F.lit(SALTS)).alias("salt"))
    salted = rows.groupBy("digest", "salt").agg(F.min("key").alias("first"), F.sum("n").alias("total"))
    firsts = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("total").alias("total"), F.collect_set("salt").alias("salts"))
    firsts = firsts.select("digest", "first", "total", F.explode("salts").alias("salt"))
    every = rows.join(firsts, ["digest", "salt"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    again = (F.col("n_bytes") >= least) & ~(F.col("key").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.replace(F.replace("key.url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("key"), F.col("digest"), F.col("copy"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(
            again,
            F.concat(
                _field("WARC-Profile", F.lit(_REVISIT)),
                _field("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"), F.lit(1))),
                _field("X-Refers-To-Page", F.col("first.id")),
            ),
        ).otherwise(""),
        _field("X-Page", F.col("key.id")),
        _field("X-Payload-Length", F.col("n_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, 0).otherwise(F.col("n_bytes"))).cast("string"),
        F.lit("\r\n\r\n"), http,
    )
    part = F.pmod(F.xxhash64("key", "copy"), _parts(F.col("total"))).cast("int")
    return every.select("digest", part.alias("part"), header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row to the tables ``payloads`` and ``records`` in ``folder``."""
    payload_store(pages, payload_col).write.parquet(f"{folder}/payloads")
    record_headers(pages, id_col, url_col, payload_col, least, date).write.option("compression", "zstd").parquet(f"{folder}/records")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC fields by lower-case name, block) of one record, which may be followed by others."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record ends before its length")
    return fields, rest[:n]


_PARSED = "page_id long, record_id string, record_type string, target_uri string, refers_to long, refers_to_record string, payload_bytes long, payload_digest string"


def _number(x: str | None) -> int | None:
    return int(x) if x else None


def _parsed(fields: dict[str, str], n_bytes: int, digest: str) -> tuple:
    get = fields.get
    return _number(get("x-page")), get("warc-record-id"), get("warc-type"), get("warc-target-uri"), _number(get("x-refers-to-page")), get("warc-refers-to"), n_bytes, digest


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of which the last ``size`` fields are bytes, by their sum."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 200 + sum(len(x) for x in r[len(r) - size :] if x is not None)
        if weight > _STEP:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SCHEMA = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_BYTES = [("payload", pa.binary()), ("record", pa.binary())]


def _restore(content: bool):
    schema = pa.schema(_SCHEMA + _BYTES * content)

    def rows(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for digest, header, n, frame in zip(*(batch.column(c).to_pylist() for c in ("digest", "header", "n_bytes", "frame")), strict=True):
                payload = unpack(frame, max_output_size=n) if n else b""
                if len(payload) != n or hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"a stored payload differs from its digest {digest.hex()}")
                head, _, http = header.partition(b"\r\n\r\n")
                kind = b"\r\nWARC-Type: revisit\r\n" in head
                record = header + (b"" if kind else payload)
                fields, block = parse_record(record)
                named = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response":
                    # The payload is read from the record itself, behind its HTTP headers.
                    own = block[block.index(b"\r\n\r\n") + 4 :]
                    found = hashlib.sha256(own).hexdigest()
                    size = len(own)
                else:
                    found, size = digest.hex(), len(payload)
                if found != named or size != int(fields["x-payload-length"]):
                    raise ValueError(f"record {fields['warc-record-id']} does not have the payload that it names")
                yield _parsed(fields, size, found) + ((payload, record) if content else ())

    return lambda batches: _batches(rows(batches), schema, 2 * content)


def read_archive(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """A row for every record, read from its restored bytes: ``page_id, record_id, record_type,
    target_uri, refers_to`` (the page that a revisit repeats)``, refers_to_record, payload_bytes,
    payload_digest`` (both of the full payload); with ``content`` also ``payload`` (full) and
    ``record`` (the record's exact bytes, without the two line ends that follow it)."""
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = spark.read.parquet(f"{folder}/records").join(payloads, ["digest", "part"]).select("digest", "header", "n_bytes", "frame")
    return both.mapInArrow(_restore(content), _PARSED + ", payload binary, record binary" * content)


def export_warc(spark: SparkSession, folder: str, path: str, compression: str = "gzip") -> None:
    """Writes the archive as WARC files. Records are text lines that end in two CRLF, so Spark's text
    writer makes the files; their payloads must be UTF-8."""
    read_archive(spark, folder, content=True).select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _members(raw: bytes) -> bytes:
    """The content of a file of one or many gzip members, or of a plain one."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out) + raw


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_archive`` with ``content``, from WARC files (plain or gzip); a revisit has no payload
    here and keeps the length and digest that it names. A file is read by one task and must be below 2 GB."""
    schema = pa.schema(_SCHEMA + _BYTES)

    def rows(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                data, at = _members(raw), 0
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at) + 4
                    length = next(int(x.partition(b":")[2]) for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    record = data[at : head + length]
                    fields, block = parse_record(record)
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("warc-type") == "response" else None
                    found = hashlib.sha256(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    size = len(payload) if payload is not None else _number(fields.get("x-payload-length"))
                    yield _parsed(fields, size, found) + (payload, record)
                    at = head + length + 4

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda b: _batches(rows(b), schema, 2), _PARSED + ", payload binary, record binary")
