"""Deterministic sharded WARC archives of web pages, and their reader.

Pages are sorted by page_id into shards of about equal payload size. Shard bounds come from an exact histogram of
sizes over ids, not from a sample, so equal tables give equal files. Each task writes whole shards, record by record,
and opens the next file of a shard once the compressed size reaches roll_bytes. Headers, block and payload digests are
made anew. Files get their names only when they are complete (written under a name of the attempt, then renamed), and
the manifest, which Spark commits, lists those that count; what a lost attempt leaves behind isn't read.

Of pages with equal payloads of MIN_REVISIT bytes or more, that of the largest page_id is a response and the others are
revisits that name it. Rows that repeat that page_id are responses as well.

Record ids are hashes of page id, payload digest and the number of the row among equal ones, so they are unique and the same
in every run; the page id itself stands in a header of its own. A target address that isn't plain ASCII is percent-encoded as
the format wants, and its original goes into another header, from which it is read back.

Null html counts as empty. A null page_id sorts first and is written without an id; its record is a revisit if a page
with an id has its payload. Ids, or rows without one, that hold more than a shard are dealt over several by their payloads,
and equal rows by their place in the table (which gives its rows in the same order when a lost task reads it again). A null url leaves the target header out. Payloads of any length pass; a task holds one record.
Rows that tie in id and payload are in the order of their addresses. An empty table gives no files. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraspark.llm.common import shared_folder, stored
from agoraspark.llm.ranges import Deal, id_ranges

MIN_REVISIT = 1000
ROLL_BYTES = 256 << 20
LEAST_SHARD = 1 << 20
EQUAL_ROWS = 1 << 40
CRLF = b"\r\n"
WRITTEN = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "file string, shard int, part int, records long, payload_bytes long, compressed_bytes long, sha256 string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digests_agree boolean, payload binary, file string"


def shard_bytes(total: int) -> int:
    """Payload bytes of a shard: grows with the root of the total, so that neither shards nor their number get large."""
    return max(LEAST_SHARD, int((total * (64 << 10)) ** 0.5))


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def _member(data: bytes) -> bytes:
    """One gzip member without a time."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, payload_sha1: str, row: int) -> str:
    """The id of a record: a name-based UUID of its page, payload (hex SHA-1) and number among equal rows."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{'' if page_id is None else page_id}:{payload_sha1}:{row}").urn


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, row: int = 0) -> bytes:
    """The record of one page: a response, or a revisit of refers_to without the payload. row: its number among equal rows."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]) + CRLF + CRLF
    block, digest = http if refers_to is not None else http + payload, hashlib.sha1(payload).hexdigest()
    headers = [("WARC-Record-ID", f"<{_urn(page_id, digest, row)}>"), ("WARC-Date", WRITTEN)]
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if url is not None:
        target = quote(url, safe="%/:?#[]@!$&'()*+,;=~")
        headers.append(("WARC-Target-URI", target))
        if target != url:
            headers.append(("Page-URL-Base64", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload))]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to, digest, 0)}>"), ("Refers-To-Page-ID", str(refers_to))]
    return _record("response" if refers_to is None else "revisit", headers, block)


class _Writer:
    """Writes the shards that one task gets, in order."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.roll_bytes = roll_bytes
        self.shard, self.part, self.out = -1, 0, None

    def add(self, shard: int, data: bytes, payload_bytes: int) -> Iterator[tuple]:
        if shard != self.shard or self.size >= self.roll_bytes:
            yield from self.close()
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard = shard
            self.open()
        self.put(data)
        self.records += 1
        self.payload += payload_bytes

    def open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.part:04d}.warc.gz"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out, self.digest = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        self.size = self.records = self.payload = 0
        info = f"software: agoraspark\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard} part {self.part}\r\n".encode()
        self.put(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", WRITTEN), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def put(self, data: bytes) -> None:
        member = _member(data)
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.store.move(self.temporary, f"{self.folder}/{self.name}")  # equal bytes replace those of an earlier attempt
        yield (self.name, self.shard, self.part, self.records, self.payload, self.size, self.digest.hexdigest())


def write_archives(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) to folder; returns the manifest, which is committed there as Parquet, and the folder.

    Payloads are shuffled once, to their shards. What a page refers to is found by ids and digests alone, and goes to
    the page's shard as a row of its own that sorts before the page.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("payload"))
    slim = stored(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n")), "payloads")
    large = slim.filter(F.col("n") >= MIN_REVISIT)
    equal = large.groupBy("digest", "n").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and keep is not null")
    equal = stored(equal.select("digest", "n", "keep"), "equal-payloads")
    # repeats of the kept id are no revisits, a missing id is one
    notes = large.join(equal, ["digest", "n"]).filter("not page_id <=> keep").select("page_id", "digest", "keep").distinct()
    total, missing = (n or 0 for n in slim.agg(F.sum("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n")))).first())
    target = shard_bytes(total)
    deal = Deal(id_ranges(slim.filter("page_id is not null").select(F.col("page_id").alias("id"), "n"), target), target, missing)
    # equal rows that hold more than a shard: fewer than there are shards
    heavy = slim.groupBy("page_id", "digest").agg(F.sum("n").alias("n")).filter(F.col("n") > target)
    heavy = F.broadcast(stored(heavy.select("page_id", "digest", F.lit(True).alias("heavy")), "heavy-payloads"))

    @F.pandas_udf("base int, parts int")
    def place_of(ids: pd.Series, known: pd.Series) -> pd.DataFrame:
        base, parts = deal.place(ids.to_numpy(np.int64), ~known.to_numpy(bool))
        return pd.DataFrame({"base": base, "parts": parts})

    place = place_of(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNotNull())
    by_digest = F.pmod(F.xxhash64("digest"), F.col("at.parts"))

    def marked(df: DataFrame) -> DataFrame:
        same = df["page_id"].eqNullSafe(heavy["page_id"]) & (df["digest"] == heavy["digest"])
        return df.withColumn("at", place).join(heavy, same, "left").select(*(df[c] for c in df.columns), "at", "heavy")

    every = F.sequence(F.lit(0).cast("long"), F.col("at.parts").cast("long") - 1)
    noted = marked(notes).withColumn("part", F.explode(F.when(F.col("heavy"), every).otherwise(F.array(by_digest))))
    bodied = rows.select("page_id", F.sha1("payload").alias("digest"), "url", "payload", F.monotonically_increasing_id().alias("nth"))
    bodied = marked(bodied).withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64("nth"), F.col("at.parts"))).otherwise(by_digest))
    shard = (F.col("at.base") + F.col("part")).cast("int").alias("shard")
    noted = noted.select(shard, "part", "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keep")
    bodies = bodied.select(shard, "part", "page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keep"))
    dealt = bodies.unionByName(noted).repartitionById(deal.shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, note, last, row = _Writer(folder, roll_bytes), (None, None, None), None, 0

        def manifest(files: list[tuple]) -> Iterator[pa.RecordBatch]:
            if files:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files, strict=True), kinds, strict=True)], [x.split()[0] for x in MANIFEST_SCHEMA.split(", ")])

        for batch in batches:
            for shard, part, page_id, digest, kind, url, body, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    note = (page_id, digest, keep)
                    continue
                refers_to = note[2] if note[:2] == (page_id, digest) else None
                row = row + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                number = part * EQUAL_ROWS + row  # apart from those of the other shards of this id
                yield from manifest(list(writer.add(shard, page_record(page_id, url, body, refers_to, number), len(body))))
        yield from manifest(list(writer.close()))

    dealt.mapInArrow(run, MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    for left in store.get_file_info(fs.FileSelector(path)):  # temporary files of attempts that failed
        if left.base_name.startswith(".pages-"):
            store.delete_file(left.path)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest"), folder


def read_members(source, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file whose every record is a gzip member."""
    open_, parts, data = zlib.decompressobj(31), [], source.read(block)
    while data:
        parts.append(open_.decompress(data))
        if not open_.eof:
            data = source.read(block)
            continue
        yield b"".join(parts)
        data, open_, parts = open_.unused_data or source.read(block), zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends within a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, the version under an empty one) and block."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])} | {"": lines[0]}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != CRLF + CRLF:
        raise ValueError("the record's length differs from its header's")
    return headers, rest[:size]


def _page_of(value: str | None) -> int | None:
    return int(value) if value else None


def _address(headers: dict[str, str]) -> str | None:
    """The page's address as it was, from its own header if the target is an encoded one."""
    original = headers.get("page-url-base64")
    return base64.b64decode(original).decode("utf-8", "surrogatepass") if original else headers.get("warc-target-uri")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit record of the manifest's files, its digests checked; payload only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string()}
        kinds |= {"refers_to": pa.int64(), "digests_agree": pa.bool_(), "payload": pa.binary(), "file": pa.string()}
        schema = pa.schema(list(kinds.items()))
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for data in read_members(source):
                        headers, block = parse_record(data)
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(CRLF + CRLF)
                        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))[16:])
                        claimed, full = headers["warc-payload-digest"], headers["warc-type"] == "response"
                        agree = headers["warc-block-digest"] == _sha1(block) and (not full or (claimed == _sha1(body) and size == len(body)))
                        page, refers_to = _page_of(headers.get("page-id")), _page_of(headers.get("refers-to-page-id"))
                        digest, kept = base64.b32decode(claimed[5:]).hex(), body if payloads and full else None
                        rows.append((page, _address(headers), size, digest, headers["warc-type"], refers_to, agree, kept, name))
                        held += len(block) if payloads else 0
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a given number, since adaptive execution would put the few small rows that name the files into one task
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, RECORD_SCHEMA)
