"""Token ids in files of bit or byte planes.

A file: chunks, then a footer of JSON, then the footer's length (8 bytes, little-endian) and b"PLNE0001".
A chunk holds up to ``CHUNK`` ids as little-endian unsigned 32-bit integers, transposed to 4 byte planes
or 32 bit planes; each plane is compressed by zstandard. The footer lists the chunks (offset, plane
lengths, ids), and where the compressed document table lies (doc_id, ids of the document).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from .base import shared_path, small_batches, stored
from .text import SPACE, Words, constants, steps, utf8

CHUNK = 1 << 18
MAGIC = b"PLNE0001"
END = 2
#: What a worker remembers of pieces: slots of the table (14 bytes each, half of them filled), ids (4 bytes each). 122 MB.
SLOTS, IDS = 1 << 22, 16_000_000
#: Bytes of the longest piece that is remembered.
LONGEST = 64
#: Full stops and commas are cut off words.
STOPS = ".,"
IS_STOP, LETTER = np.zeros(256, bool), np.zeros(256, bool)
IS_STOP[[ord(c) for c in STOPS]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Added to a word's fingerprint by what stands before it: nothing, a space, a line feed.
KINDS = constants(3, 17)


def byte_planes(ids: np.ndarray) -> list[bytes]:
    return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_byte_planes(planes: list[bytes], n: int) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").reshape(n)


def bit_planes(ids: np.ndarray) -> list[bytes]:
    return [np.packbits(((ids >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(32)]


def from_bit_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return out


PLANES = {"byte": (byte_planes, from_byte_planes), "bit": (bit_planes, from_bit_planes)}


class Writer:
    """Writes one file to any file system that pyarrow knows; ids arrive document by document."""

    def __init__(self, uri: str, planes: str = "byte", level: int = 3):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path)
        self.split, self.planes, self.zip = PLANES[planes][0], planes, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.docs, self.held, self.n = 0, [], [], [], 0

    def _put(self, blob: bytes) -> int:
        self.out.write(blob)
        self.at += len(blob)
        return len(blob)

    def _chunk(self, ids: np.ndarray) -> None:
        at = self.at
        self.chunks.append([at, [self._put(self.zip.compress(p)) for p in self.split(ids)], len(ids)])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= CHUNK:
            ids = np.concatenate(self.held)
            whole = len(ids) // CHUNK * CHUNK
            for i in range(0, whole, CHUNK):
                self._chunk(ids[i : i + CHUNK])
            self.held, self.n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n:
            self._chunk(np.concatenate(self.held))
        table = [self.at, self._put(self.zip.compress(json.dumps(self.docs).encode()))]
        foot = json.dumps({"planes": self.planes, "chunk": CHUNK, "chunks": self.chunks, "docs": table}).encode()
        self._put(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    """Reads a file's documents in order; any chunk can be read by itself."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        tail = self._at(self.file.size() - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a plane file")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self._at(self.file.size() - 16 - n, n))
        self.zip, self.join = zstandard.ZstdDecompressor(), PLANES[self.foot["planes"]][1]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, lengths, n = self.foot["chunks"][k]
        blob, planes = self._at(at, sum(lengths)), []
        for size in lengths:
            planes.append(self.zip.decompress(blob[:size]))
            blob = blob[size:]
        return self.join(planes, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in json.loads(self.zip.decompress(self._at(*self.foot["docs"]))):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def _gap(kind: int) -> str:
    """What a piece begins with: the text, a space, a line feed."""
    return ("", " ", "\n")[kind]


class Memory:
    """Ids of pieces by 64-bit fingerprint: an open-addressed table and one run of ids, both of fixed size.

    A piece that can't be encoded by itself has length -1. What doesn't fit any more clears the memory.
    """

    def __init__(self, slots: int, ids: int):
        self.slots, self.most = np.uint64(slots - 1), slots // 2
        self.keys, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int16)
        self.ids, self.used, self.end = np.zeros(ids, np.uint32), 0, 0

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = self.end = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the empty one where its search ends; and whether it is there."""
        slot = keys & self.slots
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.slots
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
        return slot, self.keys[slot] == keys

    def add(self, keys: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        """Put in distinct keys that aren't there, with ``n`` ids each, of ``flat``."""
        at = self.end + np.concatenate([[0], np.cumsum(np.maximum(n, 0))[:-1]])
        self.ids[self.end : self.end + len(flat)] = flat
        self.end += len(flat)
        self.used += len(keys)
        left = np.arange(len(keys))
        while len(left):
            slot, _ = self.find(keys[left])
            _, first = np.unique(slot, return_index=True)  # of keys that end at one slot, one takes it
            now = left[first]
            self.keys[slot[first]], self.at[slot[first]], self.n[slot[first]] = keys[now], at[now], n[now]
            left = np.delete(left, first)

    def fits(self, keys: int, ids: int) -> bool:
        return self.used + keys <= self.most and self.end + ids <= len(self.ids)


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each different piece about once.

    Byte-level pieces never span a single space or line feed between other characters, nor the place
    where a full stop or comma follows a letter and ends a word, so a text's ids are those of its parts
    between such places. A text with any other white space, or with the name of an added token, is encoded
    as a whole. ``special``: whether the name of an added token, such as <|endoftext|>, is that token's
    id, as by the library's default, or ordinary text.

    Pieces are known by 64-bit fingerprints. The memory has a fixed size in bytes (``SLOTS`` and ``IDS``),
    and longer pieces than ``LONGEST`` bytes aren't remembered.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = [c.encode() for c in self.added if c.split() != [c]]
        self.memory = Memory(SLOTS, IDS)
        self.stop = np.zeros(256, np.uint32)
        for c in STOPS:
            (self.stop[ord(c)],) = self.whole(c)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        return next(self.texts(pa.array([text], pa.string())))

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; a null is empty."""
        off, data = utf8(column)
        for lo, hi in steps(off):
            yield from self._step(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])

    def _step(self, seg: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        blank, n = SPACE[seg], len(bounds) - 1
        first, last = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
        # white space other than a space or line feed between two other characters makes its text whole
        odd = blank & (seg != 0x20) & (seg != 0x0A)
        odd[1:] |= blank[1:] & blank[:-1]
        odd[first] |= blank[first]
        odd[last] |= blank[last]
        apart = np.zeros(n, bool)
        apart[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        for name in self.spaced:
            apart |= np.array([name in seg[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], bool)
        ends = np.zeros(len(seg) + 1, bool)  # a stop after a letter, at the end of a word
        if len(seg):
            ends[1 : len(seg)] = IS_STOP[seg[1:]] & LETTER[seg[:-1]]
            ends[: len(seg) - 1] &= blank[1:] | np.isin(np.arange(1, len(seg)), first)
            ends[first] = False
        cut = np.where(ends[:-1], np.uint8(0x20), seg)
        w = Words(cut, bounds, SPACE, False)
        kind = np.zeros(len(w.hash), np.int64)
        if len(kind):
            before = seg[np.maximum(w.starts - 1, 0)]
            kind = np.where(before == 0x0A, 2, 1)
            kind[np.isin(w.starts, first)] = 0
        with np.errstate(over="ignore"):
            keys = np.maximum(w.hash + KINDS[kind], np.uint64(1))
        slot, known = self.memory.find(keys)
        if not known.all():
            extra = self._learn(keys, ~known, kind, w, seg)
            slot, known = self.memory.find(keys)
        else:
            extra = {}
        size = np.where(known, self.memory.n[slot], 0).astype(np.int64)
        for k in np.flatnonzero(~known).tolist():
            size[k] = len(extra[int(keys[k])]) if extra[int(keys[k])] is not None else -1
        text_of = np.repeat(np.arange(n), w.counts)
        apart[text_of[size < 0]] = True
        size = np.maximum(size, 0)
        stopped = ends[w.ends]
        total = size + stopped
        begin = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.uint32)
        put = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(known, size)
        source = (np.repeat(self.memory.at[slot].astype(np.int64), size) + put)[own]
        place = np.repeat(begin, size) + put
        out[place[own]] = self.memory.ids[source]
        for k in np.flatnonzero(~known & (size > 0)).tolist():
            out[begin[k] : begin[k] + size[k]] = extra[int(keys[k])]
        out[(begin + size)[stopped]] = self.stop[seg[w.ends[stopped]]]
        at = np.concatenate([begin, [len(out)]])[w.ptr]
        for d in range(n):
            yield self.whole(seg[bounds[d] : bounds[d + 1]].tobytes().decode()) if apart[d] else out[at[d] : at[d + 1]]

    def _learn(self, keys: np.ndarray, new: np.ndarray, kind: np.ndarray, w: Words, seg: np.ndarray) -> dict[int, np.ndarray | None]:
        """Encode the pieces that are new, each once, and remember them; those that aren't remembered are returned."""
        rows = np.flatnonzero(new)
        keys_, at = np.unique(keys[rows], return_index=True)
        rows = rows[at]
        pieces = [_gap(k) + seg[a:b].tobytes().decode() for k, a, b in zip(kind[rows].tolist(), w.starts[rows].tolist(), w.ends[rows].tolist())]
        fine = [_alone(p) and not any(c in p for c in self.added) for p in pieces]
        ids = iter(self.tokenizer.encode_batch_fast([p for p, f in zip(pieces, fine) if f], add_special_tokens=False))
        found = [next(ids).ids if f else None for f in fine]
        n = np.array([-1 if x is None else len(x) for x in found])
        short = (w.ends[rows] - w.starts[rows] <= LONGEST) & (n <= LONGEST)
        flat = np.array([i for x, s in zip(found, short) if s and x is not None for i in x], np.uint32)
        if not self.memory.fits(int(short.sum()), len(flat)):
            short &= False
            gone = ~new if self.memory.used else np.zeros(len(new), bool)  # the step's other pieces: learned again
            self.memory.clear()
            again = self._learn(keys, gone, kind, w, seg) if gone.any() else {}
        else:
            self.memory.add(keys_[short], n[short], flat)
            again = {}
        return again | {int(k): None if x is None else np.array(x, np.uint32) for k, x, s in zip(keys_, found, short) if not s}


def _alone(piece: str) -> bool:
    """Whether a piece can be encoded by itself: characters other than white space after at most one space or line feed."""
    rest = piece[1:] if piece[:1] in (" ", "\n") else piece
    return rest.split() == [rest]


#: A worker's encoders, kept from task to task.
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, planes: str = "byte", end: int = END, special: bool = True) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; a stored table (path, shard, n_tokens) of the files.

    Rows are dealt by ranges of doc_id (and of text where one doc_id has many rows); a task writes one
    file under a name of its own, so a task that runs twice leaves an orphan, never a torn file.
    """
    small_batches(docs.sparkSession)
    order = ["doc_id", "text_key"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer, total, texts = None, 0, encoder(tokenizer, special).texts
        uri = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                writer = writer or Writer(uri, planes)
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                writer.add(doc_id, ids)
                total += len(ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "shard": [shard], "n_tokens": [total]}, pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_tokens", pa.int64())]))

    return stored(dealt.mapInArrow(run, "path string, shard int, n_tokens long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files of ``write_tokens``.

    The driver sums the files' totals, a number a file, for where each begins.
    """
    spark = files.sparkSession
    begin, starts = 0, []
    for path, n in files.orderBy("shard").select("path", "n_tokens").collect():
        starts.append((path, begin))
        begin += n
    table = spark.createDataFrame(starts, "path string, begin long")
    if starts:
        table = table.repartition(min(len(starts), 10_000), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for doc_id, ids in Reader(path).documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str | None = None, planes: str = "byte", end: int = END, special: bool = True) -> DataFrame:
    """One row per row of ``docs`` from its files: doc_id, start, n_tokens, ids_crc32.

    A text's ids are the tokenizers library's; the name of an added token in it is that token's id unless
    ``special`` is false. A null text is empty and has its end id alone. Null doc_ids come first; rows with one doc_id follow
    each other by a hash of the text, repeated rows with equal ids. Empty tables make no file and no row.
    Extra columns are not read.
    """
    folder = shared_path(docs.sparkSession, "token-shards")
    return read_tokens(write_tokens(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), folder, planes, end, special))


__all__ = ["Encoder", "Reader", "Writer", "read_tokens", "token_table", "write_tokens"]
