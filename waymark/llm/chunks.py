"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides boundaries: rarely before a chunk has its normal size, often after it, so sizes
stay near the normal one (normalised chunking). A boundary depends on nearby bytes only, so an edit changes the chunks
around it and none further on. A text's fingerprint is its set of chunk digests with their lengths; how much of one
fingerprint another contains, by length, is its likeness to it.

For the edited texts each document meets the next one: rows are dealt out by ranges of doc_id once and sorted within each
range; the last row of a range meets the first of the next one through a small table of the ranges' ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import doc_blocks, mix, span_hashes, text_buffer

LEAST, NORMAL, MOST = 24, 48, 192
#: Bits of the gear hash that are zero at a boundary, before and after the normal size.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
GEAR_BYTES = 16
_ENTRY = np.dtype([("digest", ">u4"), ("length", "u1")])


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At i, the gear hash of the GEAR_BYTES bytes that end at i."""
    h, have = GEAR[raw], 1
    while have < GEAR_BYTES:
        longer = h.copy()
        longer[have:] += h[:-have] << np.uint32(2 * have)
        h, have = longer, 2 * have
    return h


def _next(mask: np.ndarray) -> np.ndarray:
    """At i, the first place from i on where mask holds; the length where there is none. One entry longer than mask."""
    n = len(mask)
    at = np.full(n + 1, n, np.int64)
    at[:n][mask] = np.flatnonzero(mask)
    return np.minimum.accumulate(at[::-1])[::-1]


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all chunks, row by row; all rows advance together, a chunk at a time."""
    h = gear_hashes(raw)
    strict, loose = _next((h & STRICT) == 0), _next((h & LOOSE) == 0)
    n = len(raw)
    at, stop = offsets[:-1].copy(), offsets[1:]
    rows = np.flatnonzero(at < stop)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        s = at[rows]
        # A boundary stands behind the byte whose hash shows it.
        e = strict[np.minimum(s + LEAST - 1, n)] + 1
        late = e > s + NORMAL
        e[late] = np.minimum(loose[np.minimum(s[late] + NORMAL, n)] + 1, s[late] + MOST)
        e = np.minimum(e, stop[rows])
        out.append((s, e, rows))
        at[rows] = e
        rows = rows[e < stop[rows]]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    s, e, r = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], r[order]


class Fingerprints:
    """Sets of chunk digests with lengths, of many texts: keys are (row << 32) + digest, sorted and distinct."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_buffer(texts)
        self.n = len(offsets) - 1
        keys, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in doc_blocks(offsets):
            part = raw[offsets[i] : offsets[j]]
            s, e, r = cut(part, offsets[i : j + 1] - offsets[i])
            digest = (span_hashes(part, s, e) >> np.uint64(32)).astype(np.int64)
            k, first = np.unique(((r + i) << 32) + digest, return_index=True)
            keys.append(k)
            lengths.append((e - s)[first])
        self.keys, self.lengths = np.concatenate(keys), np.concatenate(lengths)

    def totals(self) -> np.ndarray:
        return np.bincount(self.keys >> 32, self.lengths, minlength=self.n)

    def strings(self) -> list[str]:
        entries = np.zeros(len(self.keys), _ENTRY)
        entries["digest"], entries["length"] = self.keys & 0xFFFFFFFF, self.lengths
        ends = np.searchsorted(self.keys, np.arange(self.n + 1) << 32)
        return [base64.b64encode(entries[a:b].tobytes()).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """Per row, the share by length of this fingerprint's chunks that the other's has; two empty ones: 1, one: 0."""
        shared = np.isin(self.keys, other.keys, assume_unique=True)
        mine, total = np.bincount(self.keys[shared] >> 32, self.lengths[shared], minlength=self.n), self.totals()
        return np.where(total > 0, mine / np.maximum(total, 1), (other.totals() == 0).astype(float))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, new, then = (Fingerprints(pa.array(x, pa.string())) for x in (texts, changed, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(own.strings()),
            pa.array(new.strings()),
            pa.array(own.likeness(new)),
            pa.array(own.likeness(then)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted range but the last, with the row after it."""
    ids, texts = [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        texts += [t or "" for t in b.column(1).to_pylist()]
        if len(texts) > 1:
            yield _compare(ids[:-1], texts[:-1], texts[1:])
            ids, texts = ids[-1:], texts[-1:]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last row of a sorted range."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = first or (b.column(0)[0].as_py(), b.column(1)[0].as_py() or "")
            last = (b.column(0)[b.num_rows - 1].as_py(), b.column(1)[b.num_rows - 1].as_py() or "")
    if first:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at, at], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([first[0], last[0]], pa.int64()), pa.array([first[1], last[1]])], ["range", "last", "doc_id", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _compare(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per document.

    Documents follow each other by doc_id, then text; null ids come first; after the last comes the first. A null text is
    empty; an empty text's fingerprint is the empty string. A single document is its own next. An empty table: no rows.
    """
    spark = docs.sparkSession
    storage.small_batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    ends = rows.mapInArrow(_ends, "range int, last int, doc_id long, text string")  # two rows per range
    order = Window.orderBy("range", "last")
    following = F.coalesce(F.lead("text").over(order), F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    outer = ends.withColumn("following", following).where("last = 1").select("doc_id", "text", "following").mapInArrow(_pairs, RESULT)
    return rows.mapInArrow(_inner, RESULT).union(outer)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(storage.read(spark, sf_dir, "documents"))
