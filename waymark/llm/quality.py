"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are pairs of neighbouring character kinds and shapes of words (length, repetition of the word before, kinds
of characters). Their weighted frequencies, projected on the leading singular vectors of the labelled texts' term matrix,
are its latent vector. Labelled vectors are broadcast: their number is bounded by `most`. Every document's cosine with every
labelled vector is computed exactly, block by block, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import doc_blocks, span_hashes, text_buffer, words

#: At most so many labelled texts are learned from: those with the least hashes of doc_id.
MOST_LABELLED = 3000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 32, 25, 12
#: Character kinds: letters of either case, digits, white space, single marks, other marks, bytes of other characters.
MARKS = b".,!?*%&$#|@\"':;-_/"
_KIND = np.full(256, 5 + len(MARKS), np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6 + len(MARKS)
_KIND[[9, 11, 12, 32]], _KIND[[10, 13]] = 3, 4
for _i, _c in enumerate(MARKS):
    _KIND[_c] = 5 + _i
KINDS = 7 + len(MARKS)
_LENGTHS, _SHAPES = 16, 8
TERMS = KINDS * KINDS + 2 * _LENGTHS + 2 * _SHAPES


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x TERMS counts over whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[raw]
    same = row[1:] == row[:-1]
    pairs = (row[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same]
    out[:, : KINDS * KINDS] = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1)
    s, e, of = words(raw, offsets)
    if len(s):
        h = span_hashes(raw, s, e)
        again = np.zeros(len(s), np.int64)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        length = np.minimum(e - s, _LENGTHS) - 1
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        letters = np.concatenate([[0], np.cumsum((kind <= 1) | (kind == KINDS - 1))])
        shape = ((upper[e] - upper[s] > 1) * 2 + (letters[e] - letters[s] < e - s)) * 2 + (letters[e] == letters[s])
        at = KINDS * KINDS
        out[:, at : at + 2 * _LENGTHS] = np.bincount(of * 2 * _LENGTHS + again * _LENGTHS + length, minlength=n * 2 * _LENGTHS).reshape(n, -1)
        out[:, at + 2 * _LENGTHS :] = np.bincount(of * 2 * _SHAPES + again * _SHAPES + shape, minlength=n * 2 * _SHAPES).reshape(n, -1)
    return out


@dataclass
class Model:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self.weighed(counts, self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def weighed(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Square roots of each family's frequencies, times the terms' weights."""
        out = np.zeros_like(counts)
        for a, b in ((0, KINDS * KINDS), (KINDS * KINDS, KINDS * KINDS + 2 * _LENGTHS), (KINDS * KINDS + 2 * _LENGTHS, TERMS)):
            out[:, a:b] = np.sqrt(counts[:, a:b] / np.maximum(counts[:, a:b].sum(axis=1, keepdims=True), 1))
        return out * weight

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> Model:
        used = (counts > 0).sum(axis=0)
        weight = np.where(used > 0, np.log((1 + len(counts)) / (1 + used)) + 1, 0).astype(np.float32)
        x = cls.weighed(counts, weight)
        _, _, vt = np.linalg.svd(x.T @ x) if len(x) else (None, None, np.zeros((TERMS, TERMS)))
        model = cls(weight, np.ascontiguousarray(vt[:DIMENSIONS].T, np.float32), np.zeros((0, DIMENSIONS), np.float32), labels.astype(np.float32))
        model.vectors = model.project(counts).astype(np.float32)
        return model

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' weights; 0.5 where nothing is learned or nothing is alike."""
        n, k = len(counts), min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(n, 0.5)
        cos = self.project(counts).astype(np.float32) @ self.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5)


def counted(rows: DataFrame) -> DataFrame:
    """label, counts for (label, text) rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            made = [term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in doc_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for m in made for x in m], pa.binary())], ["label", "counts"])

    return rows.mapInArrow(work, "label int, counts binary")


def sample(labels: DataFrame, column: str, learn: Column, most: int) -> list[tuple[int, int]]:
    """(doc_id, label) of at most `most` labelled ids, the least by a hash; an id with several labels has the largest."""
    rows = labels.where(learn & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return [(r.doc_id, r.y) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST_LABELLED) -> Model:
    """A model of the labelled texts that `learn` chooses by their ids; without any, one that gives every text 0.5.

    Null labels and ids teach nothing; of several labels of an id the largest counts, and all texts of it are learned from.
    """
    spark = docs.sparkSession
    storage.small_batches(spark)
    known = spark.createDataFrame(sample(labels, "quality", learn, most), "__id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("label", "text")
    got = counted(rows).collect()  # bounded: `most` ids, a few kB each
    got.sort(key=lambda r: (r.label, r.counts))
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in got]).reshape(-1, TERMS)
    return Model.fit(counts, np.array([r.label for r in got]))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns named, then score; a null text is an empty one."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at, wide = rows.columns.index("text"), len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raw, offsets = text_buffer(b.column(at))
            s = [m.scores(term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in doc_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array(np.concatenate([*s, np.zeros(0)]))], [*keep, "__score"])

    schema = rows.select(*keep).schema.add("__score", "double")
    return rows.mapInArrow(work, schema)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Repeated rows are scored as often as they occur; a null id is
    not held out."""
    docs, labels = storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "labels")
    model = train(docs, labels, remainder(3) != 1)
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The documents that the classifier predicts as of quality 1, all columns unchanged; a null text is scored as an empty one.

    Without labels all stay. Repeated rows share their fate.
    """
    names = docs.columns
    model = train(docs, labels, F.lit(True), most)
    return scored(docs, model, names).where("__score >= 0.5").select(*names)
