"""MinHash near-duplicates: universal hash minima, banding, verification, star components.

1. A pass over the texts makes each document's shingle set, its digest, and band keys of its minima.
   Documents with equal sets are one class from the start, so exact copies cost one row each.
2. Buckets with two different sets give star edges; their components are candidate groups.
3. A group that fits a task is resolved there: signatures are compared, the pairs that pass are confirmed
   on full sets, and a spanning forest of the confirmed links comes out.
4. In a larger group each set meets the least other set of one of its buckets, in rounds. A round costs a row a
   set; confirmed links contract sets to parts, and only buckets with several parts go on. When a round
   hardly helps any more, the sets of these buckets meet all sets of other parts, in blocks.
   No link is lost by the choice of the sets met in the rounds, and near copies never meet in all pairs.
5. Large-star and small-star join the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .base import append_columns, lookup, masked, semi, stored
from .components import components
from .text import SPACE, constants, mix, worded

SHINGLE = 5
#: At 0.8 a pair shares no bucket once in 7,000; at 0.85 once in four million.
BANDS, ROWS = 48, 8
#: A block holds about so many sets and shingles; two blocks meet in a task.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_500_000
#: Rounds go on while one leaves at most this share of the parts that share a bucket with another, and so often at most.
PROGRESS, ROUNDS = 0.8, 8
#: A pair goes on to its full sets if its signatures agree in at least the threshold less this share: six standard deviations.
SLACK = 0.125


def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the universal hashes x -> a x + b mod 2^32 on mixed 32-bit fingerprints."""
    c = constants(2 * BANDS * ROWS, 7)
    return (c[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (c[1::2] >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set (uint32)."""
    a, b = _family()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = a[:, None] * x[None, i : i + 256]
        v += b[:, None]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band, which no other band shares."""
    with np.errstate(over="ignore"):
        v = (sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * constants(ROWS, 11)
        return mix(v.sum(axis=1, dtype=np.uint64) + constants(BANDS, 13)).view(np.int64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle fingerprints, ascending."""
    for _, _, w in worded(column, SPACE, True):
        grams = w.grams(SHINGLE, 3)
        for d, n in enumerate(w.counts):
            at = w.ptr[d]
            if n >= SHINGLE:
                yield np.unique(grams[at : at + n - SHINGLE + 1])
            elif n:  # the whole sequence
                with np.errstate(over="ignore"):
                    yield mix((w.hash[at : at + n] * constants(SHINGLE, 3)[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _features(batch: pa.RecordBatch) -> list[pa.Array]:
    sizes, digests, bands = [], [], []
    for s in shingle_sets(batch.column("text")):
        sizes.append(len(s))
        digests.append(digest_of(s))
        bands.append(band_keys(minima(s)) if len(s) else np.zeros(0, np.int64))
    ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
    flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
    return [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, bands) of ``docs`` (doc_id, text, text_key)."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return append_columns(docs.select("doc_id", "text", "text_key"), fields, _features).select("doc_id", "text_key", "n_shingles", "digest", "bands")


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 62)


def node_of():
    """A set's number among the candidates: 64 bits of its digest."""
    return F.xxhash64("digest")


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _agreement(signatures: np.ndarray) -> np.ndarray:
    """How many minima each two signatures share."""
    n = len(signatures)
    out = np.zeros((n, n), np.int16)
    for column in signatures.T:
        out += column[:, None] == column[None, :]
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections, from incidence matrices of the shingles that two sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    ids = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    shared = np.bincount(ids)[ids] > 1
    ids, owner = ids[shared], owner[shared]
    if not len(ids):
        return out
    ids = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
    cut = np.searchsorted(ids, np.arange(0, int(ids[-1]) + 2049, 2048))
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi > lo:
            m = np.zeros((n, 2048), np.float32)  # sums of ones to 2,048 are exact
            m[owner[lo:hi], ids[lo:hi] - ids[lo]] = 1
            out += (m @ m.T).astype(np.int64)
    return out


def links(sets: list[np.ndarray], percent: int, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union; sets of one part are joined already.

    Pairs pass on signatures first; those that do are confirmed on full sets.
    """
    if len(sets) < 2:
        return []
    signatures = np.stack([minima(s) for s in sets])
    passed = _agreement(signatures) >= (percent / 100 - SLACK) * signatures.shape[1]
    np.fill_diagonal(passed, False)
    if parts is not None:
        own = np.array(parts)
        passed &= own[:, None] != own[None, :]
    some = np.flatnonzero(passed.any(axis=1))
    if not len(some):
        return []
    sizes = np.array([len(sets[i]) for i in some], np.int64)
    inter = _intersections([sets[i] for i in some])
    union = sizes[:, None] + sizes[None, :] - inter
    near = np.triu(passed[np.ix_(some, some)] & (100 * inter >= percent * union), 1)
    forest, found = _Forest(len(some)), []
    for a, b in zip(*(x.tolist() for x in np.nonzero(near))):
        if forest.join(a, b):
            found.append((int(some[a]), int(some[b])))
    return found


def _tasks(keys: tuple[str, ...], solve):
    """Links of the groups in a partition that is sorted by ``keys``; one group's rows (node, set, other columns) are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            found = solve(rows)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            marks = zip(*(batch.column(c).to_pylist() for c in keys))
            for k, node, part, s in zip(marks, batch.column("node").to_pylist(), batch.column("part").to_pylist(), shingle_sets(batch.column("text"))):
                if k != key:
                    yield done()
                    key, rows = k, []
                rows.append((node, s, part))
        yield done()

    return run


def _group(percent: int):
    """Links of all sets with all, but within a part."""

    def solve(rows: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int]]:
        return [(rows[a][0], rows[b][0]) for a, b in links([s for _, s, _ in rows], percent, [p for *_, p in rows])]

    return solve


def _star(percent: int):
    """Links of the sets with the first one, the hub."""

    def solve(rows: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int]]:
        hubs = [r for r in rows if r[2] == 0]
        if not hubs:
            return []
        hub, s, _ = hubs[0]
        own, found = minima(s), []
        for node, other, part in rows:
            if part and (minima(other) == own).mean() >= percent / 100 - SLACK:
                both = len(np.intersect1d(s, other, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(other) - both):
                    found.append((hub, node))
        return found

    return solve


def _blocks(n, total):
    """In how many blocks ``n`` sets with so many shingles go."""
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _solve(rows: DataFrame, keys: tuple[str, ...], solve) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tasks(keys, solve), "u long, v long")


def star_rows(buckets: DataFrame, k: int) -> DataFrame:
    """(hub, node, weight): for each set of ``buckets`` (bucket, node, part, weight) the least hub of another part, a row a set.

    A bucket's hub is its set with the least hash of round ``k``.
    """
    order = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("hub"), F.col("part").alias("hub_part"))
    hubs = buckets.groupBy("bucket").agg(F.min(order).alias("least"))
    met = buckets.join(hubs, "bucket").where(F.col("least.hub_part") != F.col("part"))
    return met.groupBy("node").agg(F.min("least").alias("least"), F.max("weight").alias("weight")).select(F.col("least.hub").alias("hub"), "node", "weight")


def unsettled(buckets: DataFrame) -> DataFrame:
    """The rows of ``buckets`` whose bucket has several parts; of buckets with equal sets the least."""
    of = buckets.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"), F.min("node").alias("first"))
    some = of.where("a <> b").groupBy("n", "print", "first").agg(F.min("bucket").alias("bucket")).select("bucket")
    return buckets.join(some, "bucket", "left_semi")


def _parts(buckets: DataFrame) -> DataFrame:
    """(bucket, part, n, blocks, shared, total): sets of each part of a bucket, and the blocks they go in.

    A large part has blocks of its own, the small ones of a bucket share some.
    """
    parts = buckets.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    large = (F.col("n") > BLOCK_SETS) | (F.col("weight") > BLOCK_SHINGLES)
    parts = parts.withColumn("blocks", F.when(large, _blocks(F.col("n"), F.col("weight"))).otherwise(0))
    little = F.col("blocks") == 0
    of = parts.groupBy("bucket").agg(F.sum(F.when(little, F.col("n"))).alias("few"), F.sum(F.when(little, F.col("weight"))).alias("light"), F.sum("blocks").alias("own"))
    of = of.withColumn("shared", F.when(F.col("few") > 0, _blocks(F.col("few"), F.col("light"))).otherwise(0))
    return parts.join(of, "bucket").select("bucket", "part", "n", "blocks", "shared", (F.col("own") + F.col("shared")).alias("total"))


def _cost(parts: DataFrame) -> DataFrame:
    """(bucket, rows) that its sets make when each meets all blocks but those of its part."""
    return parts.groupBy("bucket").agg(F.sum(F.col("n") * (F.col("total") - F.col("blocks"))).alias("rows"))


def _paired(buckets: DataFrame) -> DataFrame:
    """(bucket, pair, node, part): the sets of every two blocks, but for two of one part."""
    parts = stored(_parts(buckets), "neardup-blocks")
    own = parts.where("blocks > 0").select("bucket", F.col("part").alias("to_owner"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"))
    shared = parts.where("shared > 0").groupBy("bucket").agg(F.max("shared").alias("shared")).select("bucket", F.lit(None).cast("long").alias("to_owner"), F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("to_block"))
    at = F.when(F.col("blocks") > 0, F.col("blocks")).otherwise(F.col("shared"))
    held = buckets.join(parts, ["bucket", "part"]).select("bucket", "node", "part", F.when(F.col("blocks") > 0, F.col("part")).alias("owner"), F.pmod(F.xxhash64("node", F.lit(1)), at).cast("int").alias("block"))
    met = held.join(shared.unionByName(own), "bucket").where("owner is null or to_owner is null or owner <> to_owner")
    here, there = F.struct("owner", "block"), F.struct(F.col("to_owner").alias("owner"), F.col("to_block").alias("block"))
    return met.select("bucket", F.xxhash64(F.sort_array(F.array(here, there))).alias("pair"), "node", "part").distinct()


def _large_groups(buckets: DataFrame, texts: DataFrame, percent: int) -> list[DataFrame]:
    """Links within the large groups: ``buckets`` (component, bucket, node, weight), ``texts`` (node, text)."""
    found: list[DataFrame] = []
    now = stored(unsettled(buckets.withColumn("part", F.col("node"))), "neardup-buckets")
    count = now.select("part").distinct().count()
    for k in range(ROUNDS):
        if not count:
            return found
        stars = stored(star_rows(now, k), "neardup-stars")
        # a hub goes to each block of its star
        sizes = stars.groupBy("hub").agg(_blocks(F.count("*"), F.sum("weight")).alias("blocks"))
        members = stars.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "node", F.lit(1).alias("part"))
        hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"), F.lit(0).alias("part"))
        found.append(stored(_solve(members.unionByName(hubs).join(texts, "node"), ("hub", "block"), _star(percent)), "neardup-star-links"))
        parts = components(_union(found), "neardup-parts").select("node", F.col("component").alias("part"))
        now = stored(unsettled(now.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))), "neardup-buckets")
        before, count = count, now.select("part").distinct().count()
        if count > PROGRESS * before:
            break
    if count:  # the sets that are left meet within their buckets or, if that makes fewer rows, within their group
        group = now.select(F.col("component").alias("bucket"), "component", "node", "part", "weight").distinct()
        by_bucket = _cost(_parts(now)).join(now.select("bucket", "component").distinct(), "bucket").groupBy("component").agg(F.sum("rows").alias("rows"))
        by_group = _cost(_parts(group)).select(F.col("bucket").alias("component"), F.col("rows").alias("group_rows"))
        whole = stored(by_bucket.join(by_group, "component").where("group_rows <= rows").select("component"), "neardup-whole")
        columns = ["bucket", "node", "part", "weight"]
        left = group.join(whole, "component", "left_semi").select(*columns).unionByName(now.join(whole, "component", "left_anti").select(*columns))
        pairs = stored(_paired(stored(left, "neardup-left")), "neardup-pairs")
        found.append(stored(_solve(pairs.join(texts, "node"), ("bucket", "pair"), _group(percent)), "neardup-block-links"))
    return found


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _marked(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of each row."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))
    feats = stored(features(keyed), "neardup-features")  # and small batches from here on
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = feats.where("n_shingles > 0").groupBy("digest").agg(F.min(row).alias("row"), F.max("n_shingles").alias("weight"))
    classes = stored(classes.select("digest", node_of().alias("node"), F.col("row.doc_id").alias("rep"), F.col("row.text_key").alias("text_key"), "weight"), "neardup-classes")
    seen = feats.where("n_shingles > 0").select(node_of().alias("node"), F.explode("bands").alias("band"))
    buckets = seen.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    edges = seen.join(buckets, "band").select(F.col("least").alias("u"), F.col("node").alias("v")).where("u <> v").distinct()
    groups = components(edges, "neardup-candidates")
    groups = groups.union(groups.select(F.col("component"), F.col("component")).distinct())
    members = stored(classes.join(groups, "node"), "neardup-members")
    fits = (F.col("n") <= 2 * BLOCK_SETS) & (F.col("total") <= 2 * BLOCK_SHINGLES)
    sizes = stored(members.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).select("component", fits.alias("fits")), "neardup-sizes")
    members = stored(lookup(members, sizes, ["component"]).select("node", "component", "rep", "text_key", "weight", "fits"), "neardup-dealt")
    one = members.select("node", F.coalesce("rep", F.lit(NO_ID)).alias("rep"), "text_key")
    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), F.xxhash64("text").alias("text_key"), "text")
    texts = semi(named, one, ["rep", "text_key"]).join(one, ["rep", "text_key"]).groupBy("node").agg(F.max("text").alias("text"))
    texts = stored(texts, "neardup-texts")  # a text for each set that may have a link
    small = members.where("fits").select("component", "node", F.col("node").alias("part")).join(texts, "node")
    found = [stored(_solve(small, ("component",), _group(percent)), "neardup-links")]
    large = members.where("not fits").select("component", "node", "weight")
    if not large.isEmpty():
        large = stored(large, "neardup-large")
        held = lookup(feats.where("n_shingles > 0").select(node_of().alias("node"), "bands"), large, ["node"]).dropDuplicates(["node"])
        held = held.select("component", F.explode("bands").alias("bucket"), "node", "weight")
        found += _large_groups(held, texts, percent)
    final = components(_union(found), "neardup-components").select("node", "component")
    of = classes.join(final, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = stored(of.join(least, "component").select("digest", "component_id"), "neardup-named")
    out = feats.select("doc_id", "text_key", "n_shingles", "digest").join(names, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct
    five-word shingles (A-Z lower-cased; the whole sequence if there are fewer words). component_id is
    the least doc_id that links reach; kept marks it.

    A null or wordless text has an empty set, is linked with nothing and is its own component. A null
    doc_id links like others, takes its component from the others (null if none has a doc_id) and is not kept.
    Rows that repeat a document are all returned, with equal values. Extra columns are not read.
    """
    return _marked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, all its columns, with one row of each near-duplicate group: that of the least doc_id.

    Of several rows with that doc_id one stays: among those whose text is in the group, by hashes of the text
    and of the row. Rows without a doc_id can't be told apart and stay.
    """
    hidden, shown = masked(docs)
    key = next(h for h, c in zip(hidden.columns, docs.columns) if c.lower() == "doc_id")
    kept = _marked(docs, percent).where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.min("text_key").alias("_text_key"))
    rows = hidden.where(F.col(key).isNotNull()).withColumn("_text_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = rows.join(stored(kept, "neardup-kept"), [key, "_text_key"], "left_semi")
    told = [f.name for f in hidden.schema if "map<" not in f.dataType.simpleString()]
    row = F.row_number().over(W.partitionBy(key, "_text_key").orderBy(F.xxhash64(*told)))
    one = rows.withColumn("_row", row).where("_row = 1").select(*shown)
    return one.unionByName(hidden.where(F.col(key).isNull()).select(*shown))
