"""WARC archives with one gzip member a record, and an offset index beside them (operator 13).

``write_monolithic`` writes pages as WARC files that are a single gzip stream each, as many crawlers leave
them: nothing in such a file can be read without inflating all that stands before it. ``normalise`` inflates
each file once as a stream, writes every record as a gzip member of its own to a new file, and an index of
offsets to a sidecar. ``read`` then divides the records of one file over many tasks.

Files are written by Spark tasks through ``pyarrow.fs``, so a folder may be any shared path or URI that it
knows. A task's files carry a name of their own, and only files whose task ended well are in the manifest,
so a lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .common import materialise, slices

GZIP = 31  # zlib's window bits for a gzip wrapper
CHUNK = 1 << 20
#: The fields of the format's standard that are written and read here.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once its records pass so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Records that a reading task takes from an archive at a time.
SPLIT_RECORDS = 512
#: A payload that more pages than this share is looked up by broadcast instead of through the shuffle.
HOT = 4096


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _clean(value: str) -> str:
    """A header value without line breaks: they would end the field."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without its payload if it refers to a page."""
    digest = hashlib.sha1(payload).hexdigest()
    # a revisit keeps the answer's own header, which states the length that is left out
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, path: str) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"{path}: a record does not begin with its version")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"{path}: a header line has no colon")
        out[name.strip().lower()] = value.strip()
    return out


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, payload, refers_to)`` from ``pages`` (page_id, url, html), one row per row.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the response (``refers_to`` null);
    the others refer to it. The digests are grouped first, without the payloads; those of payloads that very
    many pages share are looked up by broadcast, the rest by a join on the digest, so that no key of the
    join has more than HOT rows.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    src = src.withColumn("size", F.length("payload")).withColumn("digest", F.when(F.col("size") >= min_bytes, F.sha2("payload", 256)))
    many = src.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1")
    many = materialise(many, "repeated-payloads")
    hot = many.where(F.col("m") > HOT).select("digest", F.col("top").alias("hot_top"), F.lit(True).alias("hot"))
    out = src.join(bounded_broadcast(hot), "digest", "left")
    # rows that need no look-up spread by their own hash
    alone = F.col("digest").isNull() | F.col("hot").isNotNull()
    out = out.withColumn("k", F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest")))
    cold = many.where(F.col("m") <= HOT).select(F.col("digest").alias("k"), "top")
    out = out.join(cold, "k", "left").withColumn("top", F.coalesce("hot_top", "top"))
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) to ``folder`` as WARC files of one gzip stream each.

    Returns the manifest ``(path, records)``. A task closes an archive after ``archive_bytes``; a larger
    record ends the archive it begins in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out = packer = None
        path, n, size = "", 0, 0

        def done() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in slices(batches):
            for r in b.select(["page_id", "url", "payload", "refers_to"]).to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, n, size = f"{folder}/{name}", 0, 0
                    fs.create_dir(base, recursive=True)
                    out, packer = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                raw = record(**r)
                out.write(packer.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long")


def _inflated(stream, path: str) -> Iterator[bytes]:
    """The content of a gzip file, chunk by chunk, however many members it has."""
    inflater = zlib.decompressobj(GZIP)
    begun = False
    while raw := stream.read(CHUNK):
        while raw:
            begun = True
            # bounded, since a few bytes may stand for very many
            yield inflater.decompress(raw, CHUNK)
            while inflater.unconsumed_tail and not inflater.eof:
                yield inflater.decompress(inflater.unconsumed_tail, CHUNK)
            if not inflater.eof:
                break
            raw, inflater, begun = inflater.unused_data.lstrip(b"\0"), zlib.decompressobj(GZIP), False
    if begun:
        raise ValueError(f"{path} ends inside a gzip member")


class _Reader:
    """Bytes of a chunked stream up to a mark or a length, holding little more than a chunk."""

    def __init__(self, chunks: Iterator[bytes], path: str):
        self.chunks, self.path, self.held = chunks, path, b""

    def _more(self) -> bool:
        for c in self.chunks:
            if c:
                self.held += c
                return True
        return False

    def head(self) -> bytes | None:
        """The next record's header with the blank line that ends it; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > CHUNK * 4:
                raise ValueError(f"{self.path}: a record header has no end")
            if not self._more():
                if self.held:
                    raise ValueError(f"{self.path} ends inside a record")
                return None
        out, self.held = self.held[: at + 4], self.held[at + 4 :]
        return out

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError(f"{self.path} ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite the gzip WARC files that ``manifest`` names (path) into ``folder``, a member a record.

    Returns ``(path, index_path, records)``, a row per file. The sidecar has a line per record, in order:
    a JSON object with the member's offset and length and the record's type and id. A file is inflated once,
    as a stream, whether it is one member or many; no more than some chunks of it are held. A file that is
    cut off or is no WARC file is an error that names it. A file listed twice is rewritten twice.
    """

    def one(fs: pafs.FileSystem, base: str, path: str) -> tuple[str, str, int]:
        src, name = _filesystem(path)
        stem = uuid.uuid4().hex
        n = at = 0
        with (
            src.open_input_stream(name, compression=None) as stream,
            fs.open_output_stream(f"{base}/{stem}.warc.gz", compression=None) as out,
            fs.open_output_stream(f"{base}/{stem}.idx", compression=None) as idx,
        ):
            reader = _Reader(_inflated(stream, path), path)
            while (head := reader.head()) is not None:
                fields = _fields(head[:-4], path)
                packer, begin = zlib.compressobj(6, zlib.DEFLATED, GZIP), at
                at += out.write(packer.compress(head))
                for part in reader.body(int(fields["content-length"]) + 4):
                    at += out.write(packer.compress(part))
                at += out.write(packer.flush())
                entry = {"offset": begin, "length": at - begin, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
                idx.write(json.dumps(entry).encode() + b"\n")
                n += 1
        return f"{folder}/{stem}.warc.gz", f"{folder}/{stem}.idx", n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                fs.create_dir(base, recursive=True)
                new, index, n = one(fs, base, path)
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index_path", "records"])

    return _spread(manifest.select("path"), "path").mapInArrow(run, "path string, index_path string, records long")


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Few heavy rows over as many tasks as a shuffle has; their count is that of files or parts of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def parse(raw: bytes, path: str) -> dict:
    """A record's fields: id, type, page, URI, digest, size of the full payload, and the payload it has."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head, path)
    size = int(f["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{path}: a record's length is not its content's")
    answer, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = [int(x.split(b":")[1]) for x in answer.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    revisit = f["warc-type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or stated != [len(payload)]):
        raise ValueError(f"{path}: the payload of {f['warc-record-id']} is not the one of its digest")
    number = lambda k: int(f[k]) if k in f else None
    return {
        "record_id": f["warc-record-id"],
        "record_type": f["warc-type"],
        "page_id": number("x-page-id"),
        "url": _restore(f["warc-target-uri"]) if "warc-target-uri" in f else None,
        "payload_digest": digest,
        "payload_bytes": stated[0],
        "refers_to": number("x-refers-to-page-id"),
        "payload": None if revisit else payload,
    }


RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read(archives: DataFrame, split_records: int = SPLIT_RECORDS) -> DataFrame:
    """The records of normalised archives (path, index_path, records), one row each.

    The index lets any task begin at any record: an archive's records are dealt out in parts of
    ``split_records``. ``payload`` is null for a revisit; ``payload_bytes`` and ``payload_digest`` are those
    of the full payload. A payload that does not have its digest is an error.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [kinds.get(n, pa.string()) for n in names]
    first = F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(split_records)))
    parts = archives.where("records > 0").select("path", "index_path", first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, name = _filesystem(r["index_path"])
                with fs.open_input_stream(name, compression=None) as f:
                    lines = f.read().split(b"\n")[r["first"] : r["first"] + split_records]
                entries = [json.loads(x) for x in lines if x]
                fs, name = _filesystem(r["path"])
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        rows.append(parse(zlib.decompress(f.read(e["length"]), GZIP), r["path"]))
                        held += len(rows[-1]["payload"] or b"")
                        if held > CHUNK:
                            yield _batch(rows, names, types)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    return _spread(parts, "path", "first").mapInArrow(run, RECORD)


def _batch(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def archive(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder`` as normalised archives; returns their manifest
    ``(path, index_path, records)``, which ``read`` takes.

    A null html is an empty payload; null ids and urls are left out of the record and read back as null.
    Equal payloads of at least ``min_bytes`` are one response, of the largest page_id, and revisits of it;
    null ids come before all others. Rows that repeat the largest id and its payload are responses too, as
    are rows without an id whose payload no id has: there is no other page to refer to. An empty table gives
    an empty manifest; other columns are not kept.
    """
    whole = materialise(write_monolithic(revisits(pages, min_bytes), f"{folder}/monolithic", archive_bytes), "warc-monolithic")
    return materialise(normalise(whole, f"{folder}/records"), "warc-records")
