"""WARC archives of a table of pages: a deterministic sharded writer, and a reader.

Records are ordered by (id, url, payload digest). Exact running sums of payload bytes over that order
cut it into shards, so the same rows give the same archives however the input is partitioned. Each
record is made and compressed where its page is read, and travels to its shard compressed; a shard is one
task, which sorts its records, replaces repeated payloads by revisit records and rolls over to the next file by
compressed size. Files are written under temporary names, a second job moves those of the
attempts that ended well to their final names, and the manifest, written last, lists them: a folder without
manifest holds no archive, and a lost executor leaves only temporary files.

Among records with equal payloads the first in order is the response, all others are revisits of it.
Payloads under ``least`` bytes are always responses.

Edge cases: a null payload is written as an empty one; a null url has no target header; control
characters, blanks and non-ASCII characters of a url are percent-encoded; a row without id comes last in order
and is read back with a null id; rows equal in id, url and payload are a response and revisits of it,
and lie in one shard; extra columns are ignored; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.rows import arrow_map, picked
from flowlake.operators.ordering import running_sum
from flowlake.sources.durable import durable

# Shards hold so many payload bytes, or more where there would be over SHARDS of them: the driver and every task hold one key a shard.
SHARD_BYTES = 64 << 20
SHARDS = 20_000
# A file is closed before it would exceed so many compressed bytes.
FILE_BYTES = 1 << 30
# What a record weighs besides its payload when shards are cut.
_OVERHEAD = 512
DATE = "2000-01-01T00:00:00Z"
_BREAK = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
# Rows turned into Python objects at a time.
_STEP = 64


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _sha1(data: bytes) -> str:
    return base32(hashlib.sha1(data).digest())


def record_id(*parts) -> str:
    """A record's name, made from what it holds."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def member(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member; equal records have equal bytes."""
    lines = [f"{name}: {value}\r\n" for name, value in headers.items() if value is not None]
    head = f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n".encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + 2 * _BREAK) + packer.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


@dataclass(frozen=True)
class Page:
    """What is known of a page besides its payload; ``digest`` is the payload's SHA-1 in base32."""

    key: object
    url: str | None
    digest: str
    size: int

    def uri(self) -> str | None:
        return None if self.url is None else quote(self.url, safe=_VISIBLE)

    def source(self) -> str | None:
        return None if self.key is None else quote(str(self.key), safe="")

    def headers(self, kind: str, name: str, date: str) -> dict[str, str | None]:
        return {
            "WARC-Type": kind,
            "WARC-Record-ID": name,
            "WARC-Date": date,
            "WARC-Target-URI": self.uri(),
            "WARC-Payload-Digest": f"sha1:{self.digest}",
            "Content-Type": "application/http; msgtype=response",
            "X-Source-Id": self.source(),
        }

    def response(self, payload: bytes, date: str) -> bytes:
        block = http_head(len(payload)) + payload
        headers = self.headers("response", record_id("response", self), date)
        return member(headers | {"WARC-Block-Digest": f"sha1:{_sha1(block)}"}, block)

    def revisit(self, first: Page, copy: int, date: str) -> bytes:
        """A record that points to ``first`` and repeats only the head of the answer."""
        block = http_head(self.size)
        more = {
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": record_id("response", first),
            "WARC-Refers-To-Target-URI": first.uri(),
            "WARC-Refers-To-Date": date,
            "WARC-Block-Digest": f"sha1:{_sha1(block)}",
            "X-Refers-To-Source-Id": first.source(),
        }
        return member(self.headers("revisit", record_id("revisit", copy, self), date) | more, block)


def _place(key, url: str | None, digest: str) -> tuple:
    """Order of records as Python compares it: nulls last."""
    return key is None, 0 if key is None else key, url is None, url or "", digest


def digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Written ``(id, url, digest, size)`` for every page; the digest in hexadecimal."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.col(url_col).cast("string")
    rows = picked(pages, id=id_col, url=url, digest=F.sha1(payload), size=F.octet_length(payload).cast("bigint"))
    return durable(rows, "page-digests")


def repeats(narrow: DataFrame, least: int = 0) -> DataFrame:
    """``(id, url, digest, size, first_id, first_url)`` for every page whose payload occurs more than once."""
    place = F.struct(F.col("id").isNull(), "id", F.col("url").isNull(), "url")
    firsts = (
        narrow.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    return narrow.join(firsts, "digest").select("id", "url", "digest", "size", "first_id", "first_url")


def shard_keys(narrow: DataFrame, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS) -> list[tuple]:
    """The first key of every shard but the first: at most ``shards`` rows reach the driver."""
    weighed = narrow.withColumn("weight", F.col("size") + _OVERHEAD)
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    width = max(shard_bytes, -(-total // shards))
    if total <= width:
        return []
    order = [F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest").asc()]
    summed = running_sum(weighed, {"upto": "weight"}, order)
    shard = F.floor((F.col("upto") - F.col("weight")) / F.lit(width))
    place = F.struct(F.col("id").isNull(), "id", F.col("url").isNull(), "url", "digest")
    starts = summed.groupBy(shard.alias("shard")).agg(F.min(place).alias("start"))
    return sorted({_place(s["id"], s["url"], s["digest"]) for s in (r["start"] for r in starts.collect())})[1:]


_RECORD = "shard int, id {id}, url string, digest string, size bigint, kind int, first_id {id}, first_url string, record binary"


def _records(pages: DataFrame, tags: DataFrame, starts: list[tuple], date: str) -> DataFrame:
    """Compressed response records of ``pages``, and ``tags``, both with their shard."""
    id_type = pages.schema["id"].dataType.simpleString()
    nothing = [F.lit(None).cast(id_type).alias("first_id"), F.lit(None).cast("string").alias("first_url")]
    made = pages.select("id", "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(1).alias("kind"), *nothing, F.lit(0).cast("bigint").alias("size"))
    marks = tags.select("id", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "first_id", "first_url", "size")
    names = ["shard", "id", "url", "digest", "size", "kind", "first_id", "first_url", "record"]

    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                rows = part.to_pydict()
                shards, found, sizes, records = [], [], [], []
                for key, url, payload, digest, kind, size in zip(*(rows[c] for c in ("id", "url", "payload", "digest", "kind", "size"))):
                    record = None
                    if kind:
                        payload = payload or b""
                        raw, size = hashlib.sha1(payload).digest(), len(payload)
                        digest, record = raw.hex(), Page(key, url, base32(raw), size).response(payload, date)
                    shards.append(bisect_right(starts, _place(key, url, digest)))
                    found.append(digest)
                    sizes.append(size)
                    records.append(record)
                columns = {
                    "shard": pa.array(shards, pa.int32()),
                    "digest": pa.array(found, pa.string()),
                    "size": pa.array(sizes, pa.int64()),
                    "record": pa.array(records, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[n] if n in columns else part.column(n) for n in names], names=names)

    return made.unionByName(marks).mapInArrow(kernel, _RECORD.format(id=id_type))


@dataclass
class _File:
    """One archive file under its temporary name."""

    folder: str
    name: str
    shard: int
    store: object
    records: int = 0
    size: int = 0
    sha1: object = field(default_factory=hashlib.sha1)

    def __post_init__(self):
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        self._out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        about = b"software: flowlake\r\nformat: WARC File Format 1.1\r\n"
        self._put(member({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", self.name), "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, about))

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def close(self) -> tuple:
        self._out.close()
        return self.shard, self.name, self.temporary, self.records, self.size, self.sha1.hexdigest()


_MANIFEST = ["shard", "name", "temporary", "records", "bytes", "sha1"]
_MANIFEST_SCHEMA = "shard int, name string, temporary string, records bigint, bytes bigint, sha1 string"


def _written(records: DataFrame, folder: str, prefix: str, file_bytes: int, date: str) -> DataFrame:
    """Manifest rows of the files that tasks write for the shards they hold, in order."""

    def kernel(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/_temporary", recursive=True)
        out, shard, number, last, first, copies = None, None, 0, None, None, 0

        def opened():
            return _File(path, f"{prefix}-{shard:06d}-{number:05d}.warc.gz", shard, store)

        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = batch.slice(at, _STEP).to_pydict()
                for to, key, url, digest, size, kind, first_key, first_url, record in zip(*rows.values()):
                    if to != shard:
                        if out:
                            done.append(out.close())
                        shard, number, last = to, 0, None
                        out = opened()
                    page = Page(key, url, base32(bytes.fromhex(digest)), size)
                    if page != last:
                        last, first, copies = page, None, 0
                    if not kind:
                        # repeated rows have repeated marks; they all come before their records
                        first = Page(first_key, first_url, page.digest, size)
                        continue
                    if first and (copies or first != page):
                        record = page.revisit(first, copies, date)
                    copies += 1
                    if out.records and out.size + len(record) > file_bytes:
                        done.append(out.close())
                        number += 1
                        out = opened()
                    out.add(record)
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(_MANIFEST, zip(*done))}).cast(
                pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
            )

    return records.mapInArrow(kernel, _MANIFEST_SCHEMA)


def _moved(manifest: DataFrame, folder: str) -> DataFrame:
    """``manifest`` after its files have their final names; a move that an earlier attempt made is not repeated."""

    def kernel(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if store.get_file_info(f"{path}/{temporary}").type == fs.FileType.File:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"neither {temporary} nor {name} in {folder}")
            yield batch

    return manifest.mapInArrow(kernel, manifest.schema)


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 0,
    prefix: str = "pages",
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` and return the manifest ``(shard, name, records, bytes, sha1)``.

    ``folder`` must be one all executors reach (``file:``, ``hdfs:``, ``s3:`` and the like). ``date`` is every record's
    date, so that reruns agree.
    """
    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/manifest/_SUCCESS").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive")
    narrow = digests(pages, id_col, url_col, payload_col)
    starts = shard_keys(narrow, shard_bytes)
    rows = picked(pages, id=id_col, url=F.col(url_col).cast("string"), payload=F.col(payload_col).cast("binary"))
    records = _records(rows, repeats(narrow, least), starts, date)
    dealt = records.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions(
        "shard", F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest", "kind"
    )
    manifest = durable(_written(dealt, folder, prefix, file_bytes, date), "warc-files")
    _moved(manifest, folder).drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{path}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip stream, one after another."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def _head(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b": ") for line in lines.split(_BREAK)[1:])
    return {name.decode().lower(): value.decode() for name, _, value in pairs}


def parsed(record: bytes) -> dict | None:
    """A record's fields, its digests compared with its bytes; nothing for a record that describes the file."""
    head, _, rest = record.partition(2 * _BREAK)
    headers = _head(head)
    block = rest[: int(headers["content-length"])]
    if not head.startswith(b"WARC/1.1\r\n") or rest[len(block) :] != 2 * _BREAK:
        raise ValueError("not a whole WARC record")
    kind = headers["warc-type"]
    if kind == "warcinfo":
        return None
    answer, _, payload = block.partition(2 * _BREAK)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(_head(answer)["content-length"])
    whole = len(payload) == size and _sha1(payload) == digest if kind == "response" else not payload
    if not whole or headers["warc-block-digest"] != f"sha1:{_sha1(block)}":
        raise ValueError(f"{headers['warc-record-id']} does not match its digests")
    source, refers = headers.get("x-source-id"), headers.get("x-refers-to-source-id")
    return {
        "id": None if source is None else unquote(source),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": None if refers is None else unquote(refers),
        "payload": payload if kind == "response" else None,
    }


_READ = {"id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
_READ_SCHEMA = "id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def read(spark: SparkSession, folder: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """``(id, url, record_type, payload_bytes, payload_digest, refers_to[, payload])`` of every record the manifest vouches for.

    Digests, sizes and record counts are compared; what differs is an error. Files are read as streams, one a task.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    kinds = _READ if payloads else {n: k for n, k in _READ.items() if n != "payload"}
    files = max(manifest.count(), 1)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds.items()], names=list(kinds))

    def kernel(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records, size in zip(*(batch.column(c).to_pylist() for c in ("name", "records", "bytes"))):
                held, seen, weight = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in members(stream):
                        if (row := parsed(record)) is None:
                            continue
                        held.append(row)
                        seen += 1
                        weight += len(record)
                        if weight > _STEP << 17:
                            yield batch_of(held)
                            held, weight = [], 0
                if seen != records or store.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} is not the file of the manifest")
                yield batch_of(held)

    schema = _READ_SCHEMA + (", payload binary" if payloads else "")
    found = arrow_map(manifest.select("name", "records", "bytes").repartitionByRange(files, "name"), kernel, T._parse_datatype_string(schema).fields)
    cast = [F.col(c).cast(id_type).alias(c) for c in ("id",)]
    rest = [F.col(c).cast(id_type).alias(c) if c == "refers_to" else F.col(c) for c in found.columns[1:]]
    return found.select(*cast, *rest)
