"""Repeated passages: seeds on winnowed anchors, extension both ways, maximal repeats.

Of each 35 consecutive words the least fingerprint of a run of 12 is the anchor, so equal windows have
equal anchors. Documents are joined on the anchors that occur twice. Around each shared anchor the
passage is extended both ways to the run of windows that it anchors; equal extensions repeat whole.
An extension that nothing equals is compared window by window with the extensions of its anchor, one
for each wording: a hot passage costs its distinct surroundings, never its pairs. Adjacent repeated
windows join to maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .base import append_columns, semi, stored
from .text import SPACE, Words, mix, sliding, worded

WINDOW, SEED = 35, 12


def _least(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds' fingerprints, and for each window start the least of the seeds in the window."""
    grams = w.grams(SEED, 5)
    span = window - SEED + 1
    return grams, (sliding(grams, span, np.minimum) if len(grams) >= span else np.zeros(0, np.uint64))


def kept_digest(w: Words, d: int, removed: np.ndarray | None = None) -> str:
    """SHA-256 of the kept words of text ``d``, joined by one space."""
    at = np.arange(w.ptr[d], w.ptr[d + 1])
    if removed is not None:
        at = at[~removed]
    if not len(at):
        return hashlib.sha256().hexdigest()
    s, e = w.starts[at], w.ends[at]
    lens = e - s + 1  # and a space
    first = np.cumsum(lens) - lens
    take = np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(s, lens)
    take[take >= len(w.seg)] = 0
    out = w.seg[take]
    out[first + lens - 1] = 0x20
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def _seeds(window: int):
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        words, digests, anchors = [], [], []
        for _, _, w in worded(batch.column("text"), SPACE, False):
            grams, least = _least(w, window)
            for d, n in enumerate(w.counts.tolist()):
                words.append(n)
                digests.append(kept_digest(w, d))
                if n < window:
                    anchors.append(np.zeros(0, np.int64))
                    continue
                at = w.ptr[d]
                mine = least[at : at + n - window + 1]
                own = grams[at : at + n - SEED + 1]
                found = np.unique(mine)
                values, counts = np.unique(own, return_counts=True)
                twice = found[counts[np.searchsorted(values, found)] > 1]
                anchors.append(np.concatenate([found, twice]).view(np.int64))  # one that the text has twice is listed twice
        ends = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
        return [pa.array(words, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)))]

    return run


def _extensions(window: int):
    """Runs of windows with one shared anchor: anchor, first start, fingerprint of the extension, the windows' fingerprints."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, shared, at_row = [], batch.column("shared"), 0
        for _, _, w in worded(batch.column("text"), SPACE, False):
            grams, least = _least(w, window)
            prints = w.grams(window, 9)
            for d, n in enumerate(w.counts.tolist()):
                mine = []
                if n >= window:
                    at = w.ptr[d]
                    anchor = least[at : at + n - window + 1]
                    want = np.sort(shared[at_row].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    hit = want[np.minimum(np.searchsorted(want, anchor), len(want) - 1)] == anchor
                    # a run ends where the anchor changes or, in periodic text, has moved out of the window
                    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                    span = window - SEED + 1
                    cuts = np.unique(np.concatenate([np.arange(a, b, span) for a, b in zip(edge, [*edge[1:], len(anchor)])])) if len(edge) else edge
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(anchor)]):
                        if hit[a]:
                            p = prints[at + a : at + b]
                            with np.errstate(over="ignore"):
                                h = mix(np.array([int(p[0]) ^ (int(p[-1]) << 1 & (1 << 64) - 1) ^ (b - a)], np.uint64))[0]
                            mine.append({"anchor": int(anchor[a].view(np.int64)), "first": a, "extension": int(h.view(np.int64)), "windows": p.view(np.int64)})
                rows.append(mine)
                at_row += 1
        return [pa.array(rows, pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("extension", pa.int64()), ("windows", pa.list_(pa.int64()))])))]

    return run


RUNS = T.ArrayType(T.StructType([T.StructField("anchor", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("extension", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))]))


def covered(ranges: np.ndarray, window: int, n: int) -> np.ndarray:
    """Words that windows cover; ranges: first and last starts of runs of windows."""
    mark = np.zeros(n + 1, np.int64)
    if len(ranges):
        np.add.at(mark, ranges[:, 0], 1)
        np.add.at(mark, ranges[:, 1] + window, -1)
    return np.cumsum(mark)[:n] > 0


def _removal(window: int):
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        removed, digests, spans = [], [], []
        ranges, at_row = batch.column("ranges"), 0
        for _, _, w in worded(batch.column("text"), SPACE, False):
            for d, n in enumerate(w.counts.tolist()):
                gone = covered(np.array([(x["a"], x["b"]) for x in ranges[at_row].as_py()], np.int64).reshape(-1, 2), window, n)
                removed.append(int(gone.sum()))
                digests.append(kept_digest(w, d, gone))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                at_row += 1
        return [pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans.

    A word (of ``[^\\x20\\x09-\\x0D]+``, unchanged) is removed if a window of ``window`` words covers it
    whose words also start anywhere else. spans are the maximal repeats in word positions, end excluded.

    Null has no words; a text of fewer words than the window has no windows. Rows that repeat a
    document repeat all its windows. A null doc_id is an id like others. Extra columns are not read.
    """
    if window < SEED:
        raise ValueError(f"a window has {SEED} words at least")
    keyed = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id_key"))
    key = ["id_key", "text_key"]
    seeds = stored(append_columns(keyed, [T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType()))], _seeds(window)).drop("text"), "repeat-seeds")
    shared = stored(seeds.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-shared")
    hits = seeds.select(*key, F.explode(F.array_distinct("anchors")).alias("anchor")).join(shared, "anchor")
    affected = stored(hits.groupBy(*key).agg(F.collect_set("anchor").alias("shared")), "repeat-affected")
    texts = semi(keyed.drop("doc_id"), affected, key).join(affected, key)
    runs = append_columns(texts, [T.StructField("runs", RUNS)], _extensions(window)).select(*key, F.explode("runs").alias("r")).select(*key, "r.*")
    runs = stored(runs, "repeat-runs")
    # of each wording of an extension: how often, and the least place of it
    wordings = stored(runs.groupBy("anchor", "extension").agg(F.count("*").alias("n"), F.min(F.struct(*key, "first")).alias("at")), "repeat-wordings")
    single = stored(wordings.where("n = 1").select("anchor").distinct(), "repeat-single")
    told = runs.join(wordings, ["anchor", "extension"])
    whole = told.where("n > 1").select(*key, F.col("first").alias("a"), (F.col("first") + F.size("windows") - 1).alias("b"))
    chosen = told.where(F.struct(*key, "first") == F.col("at")).select(*key, "anchor", "first", "n", "windows")
    chosen = stored(chosen.join(single, "anchor", "left_semi").drop("anchor"), "repeat-chosen")
    each = chosen.select(*key, "n", "first", F.posexplode("windows").alias("pos", "window"))
    twice = stored(each.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window"), "repeat-windows")
    part = each.where("n = 1").join(twice, "window", "left_semi").select(*key, (F.col("first") + F.col("pos")).alias("a"), (F.col("first") + F.col("pos")).alias("b"))
    ranges = stored(whole.union(part).distinct().groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "repeat-ranges")
    marked = semi(keyed, ranges, key).join(ranges, key)
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("new_sha256", T.StringType()), T.StructField("spans", SPANS)]
    changed = stored(append_columns(marked, fields, _removal(window)).select(*key, "n_removed", "new_sha256", "spans").dropDuplicates(key), "repeat-changed")
    out = seeds.drop("anchors").join(changed, key, "left")  # spans have no bounded size, so no broadcast
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
