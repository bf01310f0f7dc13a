"""A deterministic sharded WARC writer and its reader.

1. Payloads (the html in UTF-8, null: empty) are keyed by SHA-256 in a narrow table (page_id, key, size).  Of pages with one
   key the largest page_id is the response; the others become decisions (page_id, key, winner).  Keys are counted with
   partial sums, and the join that finds a key's pages is one that Spark splits where a key is hot.
2. Pages are ranked by page_id without a task that holds them all, and cut into shards of about ``shard_bytes`` of payload,
   65,536 at most (their first ids are what travels to the tasks: half a megabyte).  Cuts follow from the data alone, so
   the same pages give the same files, byte for byte, on any cluster.
3. One shuffle deals pages and decisions out, a task for each shard, and sorts them by page_id; a decision precedes its page.  A task writes one
   record after another, each a gzip member, and starts a new file where the compressed size has passed ``roll_bytes``.
   Headers are regenerated: ids from the content, block and payload digests, lengths, a fixed date.
4. Files get temporary names that no other attempt uses.  What a successful task reports (name, sizes, SHA-256) is written
   as a staged manifest by Spark; only its files are then renamed, in parallel, which may be repeated; the manifest of the
   renamed files is written last.  Files of lost attempts keep their temporary names and are in no manifest.

The reader takes a manifest's files as rows, streams each and checks lengths and digests.

Defined results: a payload may be empty and has a digest then too.  Repeated rows are records of their own: of rows with one
page_id and payload the first is as decided, the others revisit it.  Rows without page_id come first; they never are what
others refer to, but refer to others; if no row of a payload has an id, all are responses.  A null url gives no target;
control characters and blanks in urls are percent-encoded.  An empty table gives an archive without files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import placed
from .common import release, scratch_path, stored

SHARD_BYTES, ROLL_BYTES, MOST_SHARDS, LEVEL = 16 << 20, 32 << 20, 1 << 16, 6
DATE = "1970-01-01T00:00:00Z"
_FILES = "shard int, file int, temporary string, name string, records bigint, responses bigint, payload_bytes bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"
_READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.fullmatch(r"file:/*(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local or uri.startswith("/") and (local := re.fullmatch(r"(/.*)", uri)) else fs.FileSystem.from_uri(uri)


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(map(str, of)).encode()).digest()[:16], version=4)}>"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, key: bytes, copy: int, payload: bytes, winner: int | None, date: str = DATE) -> bytes:
    """A response, or with a ``winner`` (the page it refers to) a revisit: the HTTP head stays, the payload goes."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if winner is not None else head + payload
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if winner is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id, key.hex(), copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{_base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_base32_sha1(block)}"),
        ("WARC-Profile", _PROFILE if winner is not None else None),
        ("WARC-Refers-To", _urn(winner, key.hex(), 0) if winner is not None else None),
        ("X-Refers-To-Page-ID", str(winner) if winner is not None else None),
        ("X-Page-ID", str(page_id) if page_id is not None else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _info(name: str, date: str = DATE) -> bytes:
    block = b"software: speechstats\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("warcinfo", name)), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{_base32_sha1(block)}"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """``data`` as a gzip member of its own, without a time or a name in its head."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _File:
    """One file of a shard under its temporary name."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, number: int):
        self.name = f"shard-{shard:06d}-{number:05d}.warc.gz"
        self.path, self.shard, self.number = f"{folder}/{self.name}", shard, number
        store.create_dir(folder, recursive=True)
        self.out, self.sum = store.open_output_stream(self.path, compression=None), hashlib.sha256()
        self.bytes = self.records = self.responses = self.payload_bytes = 0
        self.ids: list[int | None] = []
        self._write(_info(self.name))

    def _write(self, data: bytes, level: int = LEVEL) -> None:
        packed = member(data, level)
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)

    def add(self, page_id: int | None, data: bytes, response: bool, size: int, level: int) -> None:
        self._write(data, level)
        self.records, self.responses, self.payload_bytes = self.records + 1, self.responses + response, self.payload_bytes + size
        self.ids[1:] = [page_id]

    def close(self) -> list:
        self.out.close()
        return [self.shard, self.number, self.path, self.name, self.records, self.responses, self.payload_bytes, self.bytes, self.sum.hexdigest(), self.ids[0], self.ids[-1]]


def _shard(page_id: Column, first: list[int]) -> Column:
    """How many shards behind the first one start at or before ``page_id``: a search in as many steps as the count has bits."""
    if not first:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(first).bit_length()))))
    reach = lambda at, step: F.when((at + step <= len(first)) & (F.get(bounds, at + step - 1) <= page_id), at + step).otherwise(at)
    return F.when(page_id.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), reach))


def _keyed(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return rows.withColumn("key", F.unhex(F.sha2("payload", 256)))


def decisions(narrow: DataFrame) -> DataFrame:
    """page_id, key, winner of every page whose payload another one holds too; the winner's own row is among them."""
    several = narrow.groupBy("key").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 and winner is not null")
    return narrow.join(several, "key").select("page_id", "key", "winner")


def first_ids(narrow: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The smallest page_id of every shard but the first one: up to ``MOST_SHARDS`` numbers."""
    n, size = narrow.agg(F.count("*"), F.sum("bytes")).first()
    each = max(1, -(-n // MOST_SHARDS), shard_bytes * n // max(1, size or 0))
    cuts = placed(narrow.select("page_id"), [], [F.col("page_id").asc_nulls_first()], "ranked").filter((F.col("place") % each == 0) & (F.col("place") > 0) & F.col("page_id").isNotNull())
    return sorted({r.page_id for r in cuts.select("page_id").collect()})


def write_archive(pages: DataFrame, base: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes one record for each row of ``pages`` (page_id, url, html) under ``base``; gives the manifest, a row for each file."""
    spark, keyed = pages.sparkSession, _keyed(pages)
    narrow = stored(keyed.select("page_id", "key", F.octet_length("payload").cast("long").alias("bytes")), "payload-keys")
    decided, first = decisions(narrow), first_ids(narrow, shard_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    rows = keyed.select("page_id", "key", F.lit(1).alias("kind"), "url", "payload", none("long").alias("winner"))
    rows = rows.union(decided.select("page_id", "key", F.lit(0), none("string"), none("binary"), "winner"))
    dealt = rows.withColumn("shard", _shard(F.col("page_id"), first)).repartitionById(len(first) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "key", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(base)
        folder = f"{root}/_temporary/{uuid.uuid4().hex}"
        file, done = None, []
        of, winner, copy = None, None, 0
        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "page_id", "key", "kind", "url", "payload", "winner"))
            for shard, page_id, key, kind, url, payload, win in zip(*columns, strict=True):
                shard, page_id, key = shard.as_py(), page_id.as_py(), key.as_py()
                if of != (page_id, key):
                    of, winner, copy = (page_id, key), None, 0
                if not kind.as_py():
                    winner = win.as_py()
                    continue
                refers = None if winner is None or winner == page_id and not copy else winner
                if file is not None and (file.shard != shard or file.bytes >= roll_bytes):
                    number = file.number + 1 if file.shard == shard else 0
                    done.append(file.close())
                    file = _File(store, folder, shard, number)
                elif file is None:
                    file = _File(store, folder, shard, 0)
                data = payload.as_py()
                file.add(page_id, record(page_id, url.as_py(), key, copy, data, refers), refers is None, len(data), level)
                copy += 1
        if file is not None:
            done.append(file.close())
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _FILES.split(", ")])
        release()

    dealt.mapInArrow(write, _FILES).write.parquet(f"{base}/_staged")
    staged = spark.read.schema(_FILES).parquet(f"{base}/_staged")
    _spread(staged).mapInArrow(lambda batches: _commit(base, batches), _FILES).write.parquet(f"{base}/manifest")
    return read_manifest(spark, base)


def _spread(files: DataFrame) -> DataFrame:
    """Files over as many tasks as there are files, 16,384 at most: rows are small, what they name is not."""
    return files.repartition(max(1, min(files.count(), 1 << 14)))


def _commit(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renames the files of a staged manifest; one that has its name already stays."""
    store, root = _place(base)
    for batch in batches:
        for row in batch.to_pylist():
            final = f"{root}/{row['name']}"
            if store.get_file_info(row["temporary"]).type != fs.FileType.NotFound:
                store.move(row["temporary"], final)
            elif store.get_file_info(final).size != row["bytes"]:
                raise FileNotFoundError(f"{row['temporary']} is gone and {final} is not what it held")
        yield batch


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """name, shard, file, records, responses, payload_bytes, bytes, sha256, first_id, last_id of a committed archive."""
    return spark.read.schema(_FILES).parquet(f"{base}/manifest").drop("temporary")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a decompressed stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of ``_READ``, with digests checked; None for records that hold no page."""
    kind = fields["warc-type"]
    if f"sha1:{_base32_sha1(block)}" != fields["warc-block-digest"]:
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^content-length: *([0-9]+)", head)[1])
    if kind == "response" and (len(payload) != size or _base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']}")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return int(page) if page else None, fields.get("warc-target-uri"), kind, size, digest, int(refers) if refers else None, payload if kind == "response" else None


def read_archive(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits, or not asked for)."""
    files = _spread(read_manifest(spark, base).select("name", "bytes", "records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(base)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                held, size, count = [], 0, 0
                with store.open_input_stream(f"{root}/{row['name']}", compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in records(stream):
                        if (found := parse(fields, block)) is None:
                            continue
                        held.append(found if payloads else (*found[:-1], None))
                        size, count = size + (len(block) if payloads else 256), count + 1
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _READ.split(", ")])
                            held, size = [], 0
                if count != row["records"]:
                    raise ValueError(f"{row['name']} holds {count} records of {row['records']}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _READ.split(", ")])
        release()

    return files.mapInArrow(read, _READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes an archive to the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    base = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, base)
    return read_archive(pages.sparkSession, base, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
