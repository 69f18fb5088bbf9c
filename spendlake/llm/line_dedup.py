"""Line dedup over range-partitioned line hashes (operator 9).

Long lines become (hash, document, positions) rows, range-partitioned by hash and document and sorted
by hash with the largest document first. A task streams its sorted rows: the first document of a run of
equal hashes keeps its lines, later ones lose theirs once the run is known to hold enough documents.
Since the document is part of the range key, a line that a third of the documents share spreads over
many tasks; the at most two runs that touch a task's borders are settled from one summary row each.
The result is a compressed bitmap per document that loses lines, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, materialise, slices

DROP, OPEN, SUMMARY = 0, 1, 2
LINE_SCHEMA = "h1 long, h2 long, did long, th long, pos array<int>, n_lines int"
STREAM_SCHEMA = f"kind int, {LINE_SCHEMA}, n_docs long"
NO_ID = -(2**63)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list:
    """A row's document number and the digest of its text; null ids are one number below all others."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
    ]


def line_rows(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and distinct long key, with the positions of its lines."""
    src = docs.select(*_identity(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, who, where, count, total = [], [], [], [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                lines = text.split("\n")
                found: dict[bytes, list[int]] = {}
                for j, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                        found.setdefault(key.encode().lower(), []).append(j)
                for key, at in found.items():
                    h.append(xxhash.xxh3_128_digest(key))
                    where += at
                    count.append(len(at))
                who += [i] * len(found)
                total += [len(lines)] * len(found)
            hashes = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            rows = pa.array(who, pa.int64())
            pos = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *count]).astype(np.int32)), pa.array(where, pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[:, 0].copy()),
                    pa.array(hashes[:, 1].copy()),
                    b.column("did").take(rows),
                    b.column("th").take(rows),
                    pos,
                    pa.array(total, pa.int32()),
                ],
                names=["h1", "h2", "did", "th", "pos", "n_lines"],
            )

    return src.mapInArrow(run, LINE_SCHEMA)


class _Run:
    """Rows of one hash as a task streams past them; keeps back fewer than ``min_docs`` documents' rows."""

    def __init__(self, first: bool, min_docs: int):
        self.first, self.min_docs = first, min_docs
        self.n, self.top, self.last, self.held = 0, None, None, []

    def add(self, b: pa.RecordBatch, did: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.n == 0:
            self.top = did[0]
        self.n += int((did[1:] != did[:-1]).sum()) + int(self.last is None or did[0] != self.last)
        self.last = did[-1]
        self.row = b.slice(0, 1)
        if self.first:
            yield _mark(b, OPEN)
            return
        self.held.append(b.filter(pa.array(did != self.top)))
        if self.n >= self.min_docs:
            yield from (_mark(x, DROP) for x in self.held)
            self.held = []

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        """``last``: the task ends here, so the run may go on in the next one."""
        if last:
            yield from (_mark(x, OPEN) for x in self.held)
        if last or self.first:
            s = _mark(self.row, SUMMARY, self.n)
            yield s.set_column(s.schema.get_field_index("did"), "did", pa.array([self.top], pa.int64()))


def _mark(b: pa.RecordBatch, kind: int, n: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(b.num_rows, kind, np.int32)), *b.columns, pa.array(np.full(b.num_rows, n, np.int64))],
        names=["kind", *b.schema.names, "n_docs"],
    )


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, did = (b.column(c).to_numpy() for c in ("h1", "h2", "did"))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], b.num_rows]
            if now is None:
                now = _Run(True, min_docs)
            elif seen != (h1[0], h2[0]):
                yield from now.close(False)
                now = _Run(False, min_docs)
            yield from now.add(b.slice(0, stop[0]), did[: stop[0]])
            if len(start) > 1:
                yield from now.close(False)
                # runs that lie whole inside this batch
                a, z = start[1], start[-1]
                if a < z:
                    inner = start[1:-1] - a
                    docs = np.add.reduceat(np.r_[True, did[a + 1 : z] != did[a : z - 1]] | new[a:z], inner)
                    size = np.diff(np.r_[inner, z - a])
                    many, top = np.repeat(docs >= min_docs, size), np.repeat(did[a:z][inner], size)
                    if (out := many & (did[a:z] != top)).any():
                        yield _mark(b.slice(a, z - a).filter(pa.array(out)), DROP)
                now = _Run(False, min_docs)
                yield from now.add(b.slice(z), did[z:])
            seen = (h1[-1], h2[-1])
        if now is not None:
            yield from now.close(True)

    return run


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(did, th, n_lines int, n_dropped int, keep binary)`` of every document that loses lines.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but
    those of the largest id. ``keep`` is zlib over one bit per line. A null or empty text is one empty
    line. Rows of one id are one document, ``th`` tells its texts apart; null ids are one document,
    smaller than all others. Repeated rows share a bitmap. Empty tables give no rows; other columns are
    not read.
    """
    lines = materialise(line_rows(docs, min_chars, id_col, text_col), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("did").desc()]
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialise(streamed.mapInArrow(_stream(min_docs), STREAM_SCHEMA), "marked")
    # at most two summary rows per task, whatever the input
    settled = marked.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n"), F.max("did").alias("top")
    )
    settled = F.broadcast(settled.where(F.col("n") >= min_docs))
    cols = ["did", "th", "pos", "n_lines"]
    late = marked.where(F.col("kind") == OPEN).join(settled, ["h1", "h2"]).where("did < top").select(*cols)
    drops = marked.where(F.col("kind") == DROP).select(*cols).unionByName(late)
    per_doc = drops.groupBy("did", "th").agg(
        F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"), F.max("n_lines").alias("n_lines")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bits, gone = [], []
            for pos, n in zip(b.column("pos").to_pylist(), b.column("n_lines").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[pos] = False
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
                gone.append(len(pos))
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("th"), b.column("n_lines"), pa.array(gone, pa.int32()), pa.array(bits, pa.binary())],
                names=["did", "th", "n_lines", "n_dropped", "keep"],
            )

    return per_doc.mapInArrow(pack, "did long, th long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True
) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text_col``; other lines stay, joined by \\n.

    With ``counts`` also ``n_lines`` (before) and ``n_dropped``, long, which replace columns of those
    names. A null text becomes an empty one with one line. Every row of ``docs`` is returned.
    """
    added = ["n_lines", "n_dropped"] if counts else []
    kept_cols = [c for c in docs.columns if c not in added]
    src = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept_cols if c != text_col]).alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
        *_identity(docs, id_col, text_col),
    )
    joined = src.join(bitmaps.select("did", "th", "keep").hint("shuffle_hash"), ["did", "th"], "left")
    joined = joined.select("row", "content", "keep")
    schema = T.StructType(
        [
            joined.schema["row"],
            T.StructField("content", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, before, gone = [], [], []
            for text, keep in zip(b.column("content").to_pylist(), b.column("keep").to_pylist(), strict=True):
                n, lost = text.count("\n") + 1, 0
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    kept = [x for x, on in zip(text.split("\n"), bits, strict=True) if on]
                    text, lost = "\n".join(kept), n - len(kept)
                texts.append(text)
                before.append(n)
                gone.append(lost)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())],
                names=["row", "content", "n_lines", "n_dropped"],
            )

    out = joined.mapInArrow(run, schema)
    return out.select(
        *[F.col("content").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept_cols], *added
    )
