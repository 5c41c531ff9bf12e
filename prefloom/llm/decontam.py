"""Benchmark decontamination by suffix arrays of the training text.

A task numbers the words of its texts by the benchmark's vocabulary and joins texts to shards of
``SHARD_BYTES``. A shard's suffix array orders the places where a window can begin, those of a benchmark
word run of the shortest window's length. All different benchmark suffixes are binary-searched in it at
once, each in logarithmic time: the ranges found hold all verbatim matches with their places. From the
places the longest matches are followed in the benchmark's own suffix array. Marked words make the verdict.
The benchmark goes to the tasks in blocks of bounded size, one pass over a row for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .base import masked, small_batches, without
from .text import NOT_ALNUM, utf8, worded

WINDOW = 13
#: Characters of benchmark text in a block, which is broadcast.
BLOCK_CHARS = 8_000_000
#: Bytes of training text in a shard, or a single text if that is longer.
SHARD_BYTES = 16 << 20


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, hi), one range after the other, and the number of each one's range."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


class Packing:
    """Runs of words as numbers that sort like them: as many words as fit 63 bits."""

    def __init__(self, words: int, depth: int):
        self.bits = max(1, int(words + 1).bit_length())
        self.step = max(1, min(depth, 63 // self.bits))
        self.rounds = -(-depth // self.step)

    def keys(self, text: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
        """The words from ``at + start`` on; ``text`` has zeros enough at its end."""
        out = np.zeros(len(at), np.int64)
        for j in range(self.step):
            out = (out << self.bits) | text[np.minimum(at + (start + j), len(text) - 1)]
        return out

    def bounds(self, text: np.ndarray, at: np.ndarray, need: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest key of what begins with the words from ``at + start`` to ``at + need``."""
        low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j in range(self.step):
            inside = need > start + j
            word = text[np.minimum(at + (start + j), len(text) - 1)].astype(np.int64)
            low = (low << self.bits) | np.where(inside, word, 0)
            high = (high << self.bits) | np.where(inside, word, (1 << self.bits) - 1)
        return low, high

    def sort(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at`` in the order of the words that follow, up to the depth: later words count among equal ones only."""
        order, part = at, np.zeros(len(at), np.int64)
        left = np.arange(len(at))  # places of ``order`` that aren't settled, in groups that are equal so far
        for r in range(self.rounds):
            if not len(left):
                break
            key = self.keys(text, order[left], r * self.step)
            by = np.argsort(key, kind="stable") if r == 0 else np.lexsort((key, part))
            order[left], key, group = order[left][by], key[by], part[by]
            same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
            part = np.cumsum(np.concatenate([[True], ~same]))
            tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            left, part = left[tied], part[tied]
        return order


class Benchmark:
    """A block of benchmark items: vocabulary, a suffix array of all items, and its different windows."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int):
        rows = [(i, t) for i, t in rows if i is not None]
        column = pa.array([t for _, t in rows], pa.string())
        named: dict[str, list[np.ndarray]] = {}
        row = 0
        for lo, hi, w in worded(column, NOT_ALNUM, True):
            for d in range(hi - lo):
                if w.counts[d]:
                    named.setdefault(str(rows[row][0]), []).append(w.hash[w.ptr[d] : w.ptr[d + 1]].copy())
                row += 1
        self.window, self.ids = window, sorted(named)
        items = [(k, s) for k, name in enumerate(self.ids) for s in named[name]]
        seqs = [s for _, s in items]
        self.vocabulary = np.unique(np.concatenate(seqs)) if seqs else np.zeros(0, np.uint64)
        lens = np.array([len(s) for s in seqs], np.int64)
        self.first = np.cumsum(lens + 1) - lens - 1  # where each sequence begins; a 0 ends it
        self.item = np.array([k for k, _ in items], np.int64)
        self.text = np.zeros(int((lens + 1).sum()) + window, np.int32)
        owner = np.repeat(np.arange(len(seqs)), lens)
        place = np.arange(int(lens.sum())) + owner
        self.text[place] = np.searchsorted(self.vocabulary, np.concatenate(seqs)) + 1 if seqs else 0
        run = lens[owner] - (place - self.first[owner]) if len(seqs) else np.zeros(0, np.int64)
        #: the words that a suffix must match to be a hit: a window, or the whole of a short item
        need = np.minimum(window, lens[owner]) if len(seqs) else run
        self.shortest = int(need.min()) if len(need) else 0
        self.order = place[self._sorted(place, run)] if len(place) else place
        by = np.argsort(place)
        at = by[np.searchsorted(place[by], self.order)]
        owner, run, need = owner[at], run[at], need[at]
        self.owner = owner
        #: windows: different texts of that length, each a range of the suffix array
        starts = np.flatnonzero((run >= need) & ((need == window) | (run == need)))
        self.pack = Packing(len(self.vocabulary) + 1, window)
        fresh = np.ones(len(starts), bool)
        if len(starts) > 1:
            same = need[starts[1:]] == need[starts[:-1]]
            for j in range(window):
                a, b = self.text[self.order[starts[1:]] + j], self.text[self.order[starts[:-1]] + j]
                same &= (a == b) | (need[starts[1:]] <= j)
            fresh[1:] = ~same
        number = np.cumsum(fresh) - 1
        self.at, self.need = self.order[starts[fresh]], need[starts[fresh]]
        self.low = starts[fresh]
        # the items of each window; windows with equal items share a list
        pairs = np.unique(number * max(1, len(self.ids)) + self.item[owner[starts]]) if len(starts) else np.zeros(0, np.int64)
        of, item = np.divmod(pairs, max(1, len(self.ids)))
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        lists: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.list_of = np.zeros(len(cut), np.int64)
        for k, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(of)])):
            key = item[a:b].tobytes()
            if key not in lists:
                lists[key] = len(self.lists)
                self.lists.append(item[a:b])
            self.list_of[k] = lists[key]
        self.key_low, self.key_high = self.pack.bounds(self.text, self.at, self.need, 0)
        self.named: dict[tuple[int, ...], list[str]] = {}

    def _sorted(self, place: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The order of all suffixes, each up to its item's end, by doubling."""
        rank = self.text.astype(np.int64)
        whole = np.zeros(len(self.text), np.int64)
        whole[place] = run
        k = 1
        order = np.argsort(rank[place], kind="stable")
        while k <= int(run.max()):
            second = np.where(run > k, rank[np.minimum(place + k, len(rank) - 1)], 0)
            mine = rank[place]
            order = np.lexsort((second, mine))
            a, b = mine[order], second[order]
            new = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            rank = np.zeros(len(rank), np.int64)
            rank[place[order]] = new
            if new[-1] == len(new):
                break
            k *= 2
        return order

    def items_of(self, lists: tuple[int, ...]) -> list[str]:
        """The names of all items in some lists, sorted."""
        if lists not in self.named:
            if len(self.named) > 10_000:
                self.named.clear()
            found = np.unique(np.concatenate([self.lists[k] for k in lists]))
            self.named[lists] = [self.ids[k] for k in found.tolist()]
        return self.named[lists]


class Shard:
    """The suffix array of some texts, over the places where a benchmark window can begin.

    It is sorted by the words of a key first, and by the further ones where a window has the same key.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bench: Benchmark):
        self.bench, texts = bench, len(counts)
        owner = np.repeat(np.arange(texts), counts)
        # each text ends with a 0, so that no match runs into the next
        self.text = np.zeros(len(ids) + texts + bench.window, np.int32)
        self.text[np.arange(len(ids)) + owner] = ids
        self.first = np.cumsum(counts + 1) - counts - 1  # where each text begins
        stop = np.flatnonzero(self.text == 0)
        live = np.flatnonzero(self.text)
        run = stop[np.searchsorted(stop, live)] - live
        self.order = live[run >= bench.shortest] if bench.shortest else live[:0]

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Benchmark windows that the shard has, and each one's range of the suffix array."""
        bench, pack = self.bench, self.bench.pack
        keys = pack.keys(self.text, self.order, 0)
        by = np.argsort(keys, kind="stable")
        self.order, keys = self.order[by], keys[by]
        lo, hi = np.searchsorted(keys, bench.key_low, "left"), np.searchsorted(keys, bench.key_high, "right")
        some = np.flatnonzero(lo < hi)
        lo, hi = lo[some], hi[some]
        inside = np.zeros(len(keys) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        inside = np.cumsum(inside)[:-1] > 0
        self.order = pack.sort(self.text, self.order[inside])
        moved = np.concatenate([[0], np.cumsum(inside)])
        lo, hi = moved[lo], moved[hi]
        for r in range(1, pack.rounds):
            if not len(some):
                break
            low, high = pack.bounds(bench.text, bench.at[some], bench.need[some], r * pack.step)
            lo, hi = self._bisect(lo, hi, low, r, False), self._bisect(lo, hi, high, r, True)
            alive = lo < hi
            some, lo, hi = some[alive], lo[alive], hi[alive]
        return some, lo, hi

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, r: int, right: bool) -> np.ndarray:
        """For all ranges at once, where ``key`` goes among the suffixes' words of round ``r``."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            there = self.bench.pack.keys(self.text, self.order[mid], r * self.bench.pack.step)
            up = there <= key[open_] if right else there < key[open_]
            lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def longest(self, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of some places that begin with a window: its length, and a place of the benchmark that has it.

        Word by word the range of benchmark suffixes that agree narrows, by bisection. A shorter item matches whole.
        """
        bench = self.bench
        n, at = bench.need[window].copy(), bench.at[window].copy()
        alive = np.flatnonzero(n == bench.window)  # a shorter one ends with its item
        lo = bench.low[window].copy()
        hi = self._window_ends(window, lo)
        while len(alive):
            word = self.text[np.minimum(place[alive] + n[alive], len(self.text) - 1)]
            a, b = lo[alive].copy(), hi[alive].copy()
            left = _lower(bench, a, b, n[alive], word, False)
            right = _lower(bench, left, b, n[alive], word, True)
            more = (left < right) & (word > 0)
            alive, left, right = alive[more], left[more], right[more]
            lo[alive], hi[alive] = left, right
            n[alive] += 1
            at[alive] = bench.order[left]
        return n, at

    def _window_ends(self, window: np.ndarray, lo: np.ndarray) -> np.ndarray:
        bench = self.bench
        a, b = lo.copy(), np.full(len(lo), len(bench.order))
        for j in range(bench.window):
            word = bench.text[bench.at[window] + j]
            inside = j < bench.need[window]
            b = np.where(inside, _lower(bench, a, b, np.full(len(a), j), word, True), b)
        return b


def _lower(bench: Benchmark, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Where ``word`` goes among the words at ``depth`` of the benchmark suffixes from lo to hi, which agree up to there."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        there = bench.text[np.minimum(bench.order[mid] + depth[open_], len(bench.text) - 1)]
        up = there <= word[open_] if right else there < word[open_]
        lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _hits(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """All (place, window) of the shard, by place and length."""
    window, lo, hi = shard.search()
    at, which = _ranges(lo, hi)
    place, window = shard.order[at], window[which]
    by = np.lexsort((shard.bench.need[window], place))
    return place[by], window[by]


def matches(shard: Shard, place: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(place, length, sequence of the benchmark, word in it): in each text the longest match at the first hit, then the
    longest at the first hit that reaches beyond it, and so on. They hold all hit words."""
    bench = shard.bench
    if not len(place):
        return []
    # of several windows at a place the longest
    last = np.concatenate([place[1:] != place[:-1], [True]])
    place, window = place[last], window[last]
    reach = np.maximum.accumulate(place + bench.need[window])
    text = np.searchsorted(shard.first, place, "right") - 1
    now = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    found = []
    while len(now):
        n, at = shard.longest(place[now], window[now])
        sequence = np.searchsorted(bench.first, at, "right") - 1
        found += zip(place[now].tolist(), n.tolist(), sequence.tolist(), (at - bench.first[sequence]).tolist())
        # the first hit that reaches beyond the match, if it is in the same text
        next_ = np.maximum(np.searchsorted(reach, place[now] + n, "right"), now + 1)
        inside = next_ < len(place)
        now, next_ = now[inside], next_[inside]
        now = next_[text[next_] == text[now]]
    return sorted(found)


BEFORE = "_contamination_before"
MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())]))
MATCHES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))
STATE = T.StructType([T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
STATE_ARROW = pa.struct([("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _scan(column: pa.Array, bench: Benchmark) -> tuple[np.ndarray, list[list[int]], list[list[str]], list[list[dict]]]:
    """For each text of a shard: its words, hit words as edges of spans, items, and longest matches."""
    counts, ids = [], []
    v = bench.vocabulary
    for _, _, w in worded(column, NOT_ALNUM, True):
        counts.append(w.counts)
        if len(v):
            at = np.minimum(np.searchsorted(v, w.hash), len(v) - 1)
            ids.append(np.where(v[at] == w.hash, at + 1, 0).astype(np.int32))  # 0 matches nothing
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    spans, items, found = ([[] for _ in range(len(n))] for _ in range(3))
    if not len(v) or not len(n):
        return n, spans, items, found
    shard = Shard(np.concatenate(ids), n, bench)
    place, window = _hits(shard)
    if not len(place):
        return n, spans, items, found
    text = np.searchsorted(shard.first, place, "right") - 1
    end = np.maximum.accumulate(place + bench.need[window])
    fresh = np.concatenate([[True], (place[1:] > end[:-1]) | (text[1:] != text[:-1])])
    begins = np.flatnonzero(fresh)
    lasts = np.concatenate([begins[1:], [len(place)]]) - 1
    for a, b, d in zip((place[begins] - shard.first[text[begins]]).tolist(), (end[lasts] - shard.first[text[begins]]).tolist(), text[begins].tolist()):
        spans[d] += (a, b)
    lists = np.unique(text * len(bench.lists) + bench.list_of[window])
    owner, of = np.divmod(lists, len(bench.lists))
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)]):
        items[int(owner[a])] = bench.items_of(tuple(of[a:b].tolist()))
    for p, length, sequence, item_start in matches(shard, place, window):
        d = int(np.searchsorted(shard.first, p, "right") - 1)
        start = p - int(shard.first[d])
        found[d].append({"start": start, "end": start + length, "item_id": bench.ids[bench.item[sequence]], "item_start": item_start})
    return n, spans, items, found


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def _pass(block, keep: list[str], first: bool, last: bool, names: list[str]):
    """A pass over the rows for a block: what is found so far and in the block, and after the last block the verdict."""

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, spans, items, found = _scan(batch.column("text"), block.value)
        if not first:
            before = batch.column(BEFORE).to_pylist()
            spans = [_merged(x["spans"], s) for x, s in zip(before, spans)]
            items = [sorted({*x["items"], *i}) if i else x["items"] for x, i in zip(before, items)]
            found = [sorted(a + b, key=lambda m: (m["start"], m["end"], m["item_id"])) for a, b in zip(batch.column("matches").to_pylist(), found)]
        made = [pa.array(n, pa.int64()), pa.array(found, MATCHES_ARROW)]
        if last:
            hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            digest = {}
            for i in items:
                key = tuple(i)
                if key not in digest:
                    digest[key] = hashlib.sha256(",".join(i).encode()).hexdigest()
            made += [pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([digest[tuple(i)] for i in items], pa.string())]
        else:
            made.append(pa.array([{"spans": s, "items": i} for s, i in zip(spans, items)], STATE_ARROW))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            off, _ = utf8(batch.column("text"))
            held.append(batch)
            size += int(off[-1] - off[0])
            if size >= SHARD_BYTES:
                yield shard(_joined(held))
                held, size = [], 0
        if held:
            yield shard(_joined(held))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, window: int = WINDOW):
    """The benchmark in broadcast blocks whose size is checked: by a hash of the item, as many as its characters need."""
    spark = benchmark.sparkSession
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(Benchmark([tuple(r) for r in part.select("item_id", "text").collect()], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all its columns, with n_words, matches, n_hit, n_items, items_sha256, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window`` words of an
    item, or the whole of a shorter one. ``matches`` (start and end in document words, item_id, item_start) are longest
    verbatim matches that hold a window: the longest at the first hit of a text, then the longest at the first hit
    that reaches beyond it; each names one item that has it (a block of the benchmark for itself), and together they
    hold all hit words. n_items and items_sha256 are of all items with a window in the text. contaminated: at least
    a twentieth of the words is hit.

    A null or wordless text has no words, hits or items. Items without words or without an id are no
    items; repeated items count once by id. Input columns with an output's name are replaced.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", MATCHES)]
    result = [T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]
    out, blocks = docs, list(blocks_of(benchmark, block_chars, window))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        made = fields + (result if last else [T.StructField(BEFORE, STATE)])
        keep = without(out, [f.name for f in fields + result] + [BEFORE, "contaminated"])
        schema = T.StructType([f for f in out.schema if f.name in keep] + made)
        out = out.mapInArrow(_pass(block, keep, k == 0, last, [*keep, *(f.name for f in made)]), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, its columns alone, without the contaminated ones."""
    hidden, shown = masked(docs)
    return contamination(hidden, benchmark).where(~F.col("contaminated")).select(*shown)
