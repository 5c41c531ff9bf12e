"""Language by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .base import append_columns, stored
from .text import utf8

#: Bounds of what is learned: texts of each language, characters of a text that is taken first, bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY = 100, (20, 5_000), 8_000
#: So many languages can be told apart, as all dictionaries go to every task; more are an error, never dropped.
LANGUAGES = 5_000
#: A text is compressed in blocks of so many bytes, so that the dictionaries matter in all of it.
BLOCK, LEVEL = 4096, 5
#: A lead below this share of the smallest size is too narrow for a verdict.
MARGIN = 0.01


def training_fold(id_column: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder 1 by 3: rows to learn from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def dictionary(texts: list[str]) -> bytes:
    """The texts' different words, the most frequent last, where matches are cheapest.

    Words stand apart from their neighbours, so that a passage that a text shares with the sample of
    another language saves no more than its words.
    """
    counts = Counter(w for t in texts for w in t.split())
    return " ".join(sorted(counts, key=lambda w: (counts[w], w))).encode()[-DICTIONARY:]


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary for each lang, the most common first, from training texts: the SAMPLE_DOCS with the
    least hashes among those of SAMPLE_CHARS characters; for a lang that has none of these among its others, as far
    as SAMPLE_CHARS goes. Only dictionaries reach the driver. More than LANGUAGES languages raise an error."""
    fits = F.length("text").between(*SAMPLE_CHARS)
    sized = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text", fits.alias("_fits"))
    rows = sized.where(training_fold()).select("doc_id", "lang", "_fits")
    common = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()}
    if len(common) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages to learn")
    ranked = rows.selectExpr("*", "row_number() over (partition by lang order by _fits desc, xxhash64(doc_id), doc_id) AS _n").where(F.col("_n") <= SAMPLE_DOCS)
    chosen = ranked.groupBy("lang").agg(F.max("_fits").alias("_fits"), F.collect_set(F.when(F.col("_fits"), F.col("doc_id"))).alias("fit"), F.collect_set("doc_id").alias("all"))  # each at most SAMPLE_DOCS ids
    chosen = stored(chosen.select("lang", "_fits", F.explode(F.when(F.col("_fits"), F.col("fit")).otherwise(F.col("all"))).alias("doc_id")), "langid-sample")
    texts = sized.join(F.broadcast(chosen), ["lang", "doc_id", "_fits"], "left_semi").groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS[1])).alias("text"))
    made = texts.groupBy("lang").applyInArrow(_dictionaries, "lang string, blob binary")  # a group is at most SAMPLE_DOCS short texts
    blobs = dict(tuple(r) for r in made.collect())
    return {lang: bytes(blobs[lang]) for lang in sorted(blobs, key=lambda x: (-common.get(x, 0), x))}


def _dictionaries(table: pa.Table) -> pa.Table:
    texts = [t.lower() for t in table.column("text").to_pylist()]
    return pa.table({"lang": [table.column("lang")[0].as_py()], "blob": [dictionary(texts)]}, pa.schema([("lang", pa.string()), ("blob", pa.binary())]))


def sizes(blocks: list[bytes], compressors: list) -> np.ndarray:
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], np.int64)


def _classify(model, margin: float):
    state: list = []

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        names = list(model.value)
        if not state:
            for blob in model.value.values():
                d = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                state.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        column = batch.column("text")
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_pylist()
        off, data = utf8(pc.utf8_lower(column))
        raw = data.tobytes()
        langs, scores, rejected = [], [], []
        for i, has in enumerate(letters):
            if not has or not names:
                langs.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            lo, hi = int(off[i]), int(off[i + 1])
            size = sizes([raw[k : min(k + BLOCK, hi)] for k in range(lo, hi, BLOCK)], state)
            order = np.argsort(size, kind="stable")
            best = int(size[order[0]])
            lead = (int(size[order[1]]) - best) / max(best, 1) if len(order) > 1 else 1.0
            langs.append(names[order[0]])
            scores.append(1 - math.exp(-lead / 0.02))
            rejected.append(lead < margin)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    return run


def languages(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs``, all its columns, with lang_pred, score and rejected.

    lang_pred is the learned language with the smallest size (of equal sizes the more common); score
    grows from 0 to 1 with its lead; rejected tells that the lead is narrower than ``margin``. Texts are
    lower-cased and compressed whole, in blocks. Null and letterless texts, and all texts where nothing could be
    learned, are "und", score 0, rejected. Repeated rows get equal values and, if they have one doc_id, teach once
    (the least of their texts); rows without doc_id aren't learned from. Input columns with an output's name are
    replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, fields, _classify(model, margin))


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
