"""Quality by nearest-neighbour voting on latent-semantic vectors.

Terms are hashed byte trigrams and a few shapes of words. Document frequencies are of all documents.
A bounded sample of labelled rows is decomposed to latent vectors in a task; the driver sees the model
alone, neither texts nor their matrix, and broadcasts it. Every document's vector is compared with all of
them in exact blocked products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .base import append_columns, masked, small_batches, stored
from .langid import training_fold
from .text import SPACE, Words, steps, utf8

TRIGRAMS, SHAPES, LATENT = 4096, 4, 64
#: Labelled rows that are learned from, at most; those with the least hashes of their ids.
SAMPLE = 4000
NEIGHBOURS, BLOCK = 15, 512
#: Similarities count to this power, so that close neighbours outvote the others.
SHARP = 8
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and their counts for each text; none for a null or empty one."""
    off, data = utf8(column)
    for lo, hi in steps(off):
        w = Words(data, off[lo : hi + 1], SPACE, False)
        b = w.seg.astype(np.uint32)
        if len(b) > 2:
            with np.errstate(over="ignore"):
                tri = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
        else:
            tri = np.zeros(0, np.uint32)
        same = np.concatenate([[False], w.hash[1:] == w.hash[:-1]]) if len(w.hash) else np.zeros(0, bool)
        upper = UPPER[w.seg[w.starts]] & UPPER[w.seg[w.ends - 1 - (w.ends - w.starts > 2)]] & (w.ends - w.starts > 1)
        bounds = off[lo : hi + 1] - off[lo]
        for d in range(hi - lo):
            counts = np.bincount(tri[bounds[d] : max(bounds[d], bounds[d + 1] - 2)], minlength=TRIGRAMS + SHAPES)
            at = slice(w.ptr[d], w.ptr[d + 1])
            n = w.counts[d]
            if n:
                repeated = same[at].copy()
                repeated[0] = False
                shapes = [repeated.sum(), upper[at].sum(), n - len(np.unique(w.hash[at])), (w.ends[at] - w.starts[at] == 1).sum()]
                # a shape counts where a share of the words has it, on a scale of 64
                counts[TRIGRAMS:] = [64 * int(s) // int(n) for s in shapes]
            terms = np.flatnonzero(counts)
            yield terms, counts[terms]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many there are: a fixed number of sums reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TRIGRAMS + SHAPES + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for terms, _ in term_counts(batch.column("text")):
                df[terms] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["term", "df"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(TRIGRAMS + SHAPES + 1, np.int64)
    for term, n in rows:
        df[term] = n
    return df[:-1], int(df[-1])


def weighed(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).astype(np.float32)


def decompose(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by a randomised range finder."""
    rng = np.random.default_rng(3)
    y = x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, texts: list[str], labels: list[int]):
        self._fit(idf, self.rows(idf, pa.array(texts, pa.string())), labels)

    @classmethod
    def of(cls, idf: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Model:
        """Of batches (text, label) whose texts are held one batch at a time."""
        made, rows, labels = cls.__new__(cls), [], []
        for batch in batches:
            rows += cls.rows(idf, batch.column("text"))
            labels += batch.column("label").to_pylist()
        made._fit(idf, rows, labels)
        return made

    @staticmethod
    def rows(idf: np.ndarray, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms and their weights."""
        return [(terms, weighed(terms, counts, idf)) for terms, counts in term_counts(column)]

    def _fit(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> None:
        self.idf = idf
        x = np.zeros((len(rows), len(idf)), np.float32)
        for row, (terms, weights) in zip(x, rows):
            row[terms] = weights
        self.basis = decompose(x, min(LATENT, len(rows))) if len(rows) else np.zeros((len(idf), 1), np.float32)
        self.vectors = unit(x @ self.basis)
        self.labels = np.array(labels, np.float64)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5

    def scores(self, column: pa.Array) -> np.ndarray:
        rows = [weighed(t, c, self.idf) @ self.basis[t] for t, c in term_counts(column)]
        out = np.full(len(rows), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(rows) if k else 0, BLOCK):
            x = unit(np.stack(rows[i : i + BLOCK]))
            cosine = x @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARP
            total = weight.sum(axis=1)
            some = total > 0
            out[i : i + len(x)][some] = ((weight * self.labels[near]).sum(axis=1)[some] / total[some]).clip(0, 1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(norm > 0, x / np.maximum(norm, 1e-12), 0).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of at most ``SAMPLE`` labelled training rows and all documents' term statistics.

    Of several labels of a document the least counts; rows without id, text or label teach nothing.
    """
    df, n = document_frequencies(docs)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.05, 0)
    rows = labels.where(training_fold() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    have = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id")
    chosen = stored(rows.join(have, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "quality-sample")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("label"))  # of several texts of a document the least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model.of(idf, batches), 5)], pa.binary())], names=["model"])

    made = texts.repartition(1).sortWithinPartitions("doc_id").select("text", "label").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model(idf, [], [])  # an empty plan may have no task


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs``, all its columns, with score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts are scored. A text without terms (null, empty, one or two characters) and one that is
    near no neighbour scores the share of labels 1; where nothing is labelled that is 0.5. Ties among
    neighbours fall by position in the sample, which is ordered by doc_id. Input columns named score or
    predicted are replaced.
    """
    return scored(docs, learn(docs, labels, label))


def scored(docs: DataFrame, trained: Model) -> DataFrame:
    """``docs`` with score and predicted of a trained model, which is broadcast; its size is bounded by SAMPLE, LATENT and the terms."""
    model = docs.sparkSession.sparkContext.broadcast(trained)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = model.value.scores(batch.column("text"))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return append_columns(docs, fields, run)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, its columns alone, without those that the classifier rejects."""
    hidden, shown = masked(docs)
    return scored(hidden, learn(docs, labels)).where("predicted = 1").select(*shown)
