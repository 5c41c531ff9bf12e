"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.llm import components, decontam, langid, licenses, mixing, neardup, quality, rules, substrings, tokens, warc

from ..conftest import rows
from . import brute


def listed(x):
    return sorted(x, key=repr)


# --- near-duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(documents, texts, percent):
    assert rows(neardup.near_duplicates(documents, percent)) == listed(brute.near_duplicates(texts, percent))


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_near_duplicates_in_blocks(documents, texts, monkeypatch, rounds):
    """Rounds of stars and blocks of three sets lose no link."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 3)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    assert rows(neardup.near_duplicates(documents)) == listed(brute.near_duplicates(texts))


def chained(n, seed, step):
    """Texts of which each is the one before with ``step`` words changed: neighbours are near, others less and less."""
    rng = random.Random(seed)
    words, out = [f"s{seed}w{k}" for k in range(120)], []
    for k in range(n):
        for _ in range(step):
            words[rng.randrange(len(words))] = f"s{seed}x{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rounds", [1, 8])
def test_near_duplicates_in_chains(spark, monkeypatch, rounds):
    """Large groups with many parts, linked in chains or not at all, and a link over a row without id."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 4)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    docs = [(k, t) for k, t in enumerate(chained(60, 1, 1) + chained(40, 2, 3) + chained(30, 3, 4))]
    docs = [(None if k == 30 else k, t) for k, t in docs] + [(500, docs[3][1]), (None, docs[70][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(neardup.near_duplicates(df)) == listed(brute.near_duplicates(docs))


def test_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    """Many near copies of a page and some strays: the rows that meet grow with the group, not with its square."""
    dealt = []
    solve = neardup._solve
    monkeypatch.setattr(neardup, "_solve", lambda rows, *a: dealt.append(rows.count()) or solve(rows, *a))
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    rng, docs = random.Random(4), []
    page = [f"w{k}" for k in range(200)]
    for n in range(500):
        words = list(page)
        for _ in range(1 if n % 50 else 9):
            words[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        docs.append((n, " ".join(words)))
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(dealt) < 6 * len(docs)
    assert rows(out) == listed(brute.near_duplicates(docs))


def test_deduplicated_rows_of_one_id(spark):
    """Of several rows of an id that of the group stays, the same on any partitioning; clashing names come back as they were."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(1, text, "a", 5), (1, "other words here", "b", 6), (2, text, "c", 7), (3, text + " x", "d", 8), (1, text, "e", 9), (None, text, "f", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string, _text_key int")
    got = [listed(tuple(r) for r in neardup.deduplicated(df.repartition(n), 80).collect()) for n in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == 2 and {r[0] for r in got[0]} == {1, None}


def test_near_duplicates_of_nothing(empty):
    assert rows(neardup.near_duplicates(empty)) == []


def test_deduplicated(documents, texts):
    kept = neardup.deduplicated(documents, 80)
    assert kept.columns == documents.columns
    want = {i for i, _, _, k in brute.near_duplicates(texts, 80) if k}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (None, 1), (1, 2), (2, 1)] + [(0, k) for k in range(400, 500)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = sorted((i, root(i)) for i in up if root(i) != i)
    assert rows(components.components(spark.createDataFrame(edges, "u long, v long"))) == sorted(want, key=repr)
    assert rows(components.components(spark.createDataFrame([], "u long, v long"))) == []


# --- decontamination


def bench(texts):
    long = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(long, (13, 14, 40, 30, 20, 60)))]
    return items + [(90, "x"), (91, ""), (92, None), (None, "one two three"), (93, "one two, THREE!"), (94, "b c"), (2, "same same same same")] + items[:1]


@pytest.mark.parametrize("block", [8_000_000, 200])
def test_contamination(spark, documents, texts, block):
    b = bench(texts)
    table = spark.createDataFrame(b, "item_id long, text string")
    marked = decontam.contamination(documents, table, block_chars=block)
    assert set(documents.columns) <= set(marked.columns)
    got = rows(marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == listed(brute.contamination(texts, b))


def test_contamination_of_nothing(spark, documents, empty, texts):
    table = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(documents, table).where("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(empty, table).count() == 0
    assert decontam.decontaminated(documents, spark.createDataFrame(bench(texts), "item_id long, text string")).columns == documents.columns


def test_longest_matches(spark):
    """A match is longest and located."""
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[3:33]) + " c")], "doc_id long, text string")
    table = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    m = decontam.contamination(docs, table).first()["matches"]
    assert [(x.start, x.end, x.item_id, x.item_start) for x in m] == [(2, 32, "5", 3)]


@pytest.mark.parametrize("window", [2, 3, 5, 13])
def test_suffixes(window):
    """Few words, so that windows, short items and copies overlap: hits, items and matches against brute force."""
    import pyarrow as pa

    rng, vocabulary = random.Random(window), [f"w{k}" for k in range(6)]
    for _ in range(60):
        bench_ = [(rng.choice([k, k, 1, None]), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 8, 14, 20]))) if rng.random() > 0.05 else None) for k in range(rng.randint(0, 7))]
        docs = [(k, " ".join(rng.choices([*vocabulary, "zz"], k=rng.choice([0, 1, 4, 10, 30, 60])))) for k in range(8)]
        docs = [(k, t + " " + ((rng.choice(bench_)[1] if bench_ and rng.random() < 0.5 else "") or "")) for k, t in docs]
        n, spans, items, found = decontam._scan(pa.array([t for _, t in docs]), decontam.Benchmark(bench_, window))
        texts = {}
        for i, t in bench_:
            if i is not None and t:
                texts.setdefault(str(i), []).append(t.split())
        has = lambda seg, ts: any(t[p : p + len(seg)] == seg for t in ts for p in range(len(t)))
        for k, want in enumerate(brute.contamination(docs, bench_, window)):
            hit = sum(spans[k][1::2]) - sum(spans[k][::2])
            assert (k, int(n[k]), hit, len(items[k]), hashlib.sha256(",".join(items[k]).encode()).hexdigest()) == want[:5]
            words, covered = docs[k][1].split(), set()
            for m in found[k]:
                seg = words[m["start"] : m["end"]]
                assert any(t[m["item_start"] :][: len(seg)] == seg for t in texts[m["item_id"]])
                longer = words[m["start"] : m["end"] + 1]
                assert len(seg) < window or len(longer) == len(seg) or not has(longer, [t for ts in texts.values() for t in ts])
                covered |= set(range(m["start"], m["end"]))
            assert len(covered) == hit


def test_a_large_benchmark():
    """10,000 items of ordinary words against some megabytes, and 1,000 items that share a prompt: no more than the items' names a document."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(1)
    vocabulary, p = [f"v{k}" for k in range(20_000)], 1 / np.arange(1, 20_001)
    draw = lambda n: rng.choice(vocabulary, n, p=p / p.sum()).tolist()
    words, prompt = draw(800_000), " ".join(draw(20))
    items = [(k, " ".join(words[80 * k : 80 * k + 80])) for k in range(10_000)]
    text = " ".join(draw(150_000))
    bench_ = decontam.Benchmark(items + [(20_000 + k, f"{prompt} {k}") for k in range(1000)], 13)
    docs = pa.array([text[k : k + 3000] + f" {prompt} end" for k in range(0, len(text), 3000)] * 4)
    began = time.process_time()
    _, spans, found_items, found = decontam._scan(docs, bench_)
    assert time.process_time() - began < 30
    assert all(len(x) == 1000 for x in found_items) and all(len(s) == 2 for s in spans) and all(len(m) == 1 for m in found)


# --- repeated passages


@pytest.mark.parametrize("window", [35, 12])
def test_repeated_passages(documents, texts, window):
    got = substrings.repeated_passages(documents, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(got) == listed(brute.repeated_passages(texts, window))


def test_repeated_passages_of_nothing(empty):
    assert rows(substrings.repeated_passages(empty)) == []
    with pytest.raises(ValueError):
        substrings.repeated_passages(empty, 5)


def test_passages_with_different_surroundings(spark):
    """Windows at the borders of a hot passage that only some of its texts share."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(45)]
    left, right = [f"l{k}" for k in range(20)], [f"r{k}" for k in range(20)]
    docs = []
    for k in range(40):
        a, b = rng.randint(0, 20), rng.randint(0, 20)
        docs.append((k, " ".join([f"x{k}"] * 3 + left[a:] + passage + right[:b] + [f"y{k}"] * 3)))
    got = substrings.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(got) == listed(brute.repeated_passages(docs))


# --- rules


def test_statistics(documents, texts):
    got = rules.statistics(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("failed"))
    assert rows(got) == listed(brute.statistics(texts))


def test_decision_list(spark):
    """Symbols and capitals mark bad texts; the list finds that."""
    rng = random.Random(2)
    docs = []
    for k in range(600):
        w = ["".join(rng.choices("abcdefg", k=5)) for _ in range(40)]
        docs.append((k, " ".join(x + "***" for x in w) if k % 5 == 0 else " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    labels = spark.createDataFrame([(k, int(k % 5 > 0 and k % 7 > 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    got = {r.doc_id: r.kept for r in out.collect()}
    assert got == {k: k % 5 > 0 and k % 7 > 0 for k in range(600)}
    text = out.first()["rule"]
    assert ";" in text and "upper_share" in text
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_without_labels(spark, documents, empty, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.quality_rules(documents, none)
    assert out.where("kept = base_failed").count() == 0 and out.count() == len(texts)
    assert rules.quality_rules(empty, none).count() == 0


# --- WARC


def pages(spark):
    big = "é<p>" * 50_000
    data = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, None, "same"), (3, "http://a/3\r\nX: y", big), (4, "u", ""), (6, "u", None), (7, "u", "WARC/1.1\r\n\r\n"), (5, None, "same"), (None, "u", "same"), (None, "u", "lone")]
    return data, spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, payload_digest string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_captures(spark, least):
    data, df = pages(spark)
    top = {}
    for i, _, h in data:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            top[b] = max(i, top.get(b, -1))
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        revisit = b in top and i != top[b]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[b] if revisit else None))
    assert rows(warc.captures(df, least)) == listed(want)


def test_captures_of_nothing(spark):
    _, df = pages(spark)
    assert rows(warc.captures(df.limit(0))) == []


def test_transactions(spark, tmp_path):
    data, df = pages(spark)
    table = warc.stored(warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/w")), "test-records")
    nested = warc.transactions(table).collect()
    assert len(nested) == len(data) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in nested)
    assert {bytes(r.response.payload) for r in nested if r.response.type == "response"} == {(h or "").encode() for _, _, h in data}
    assert all("\r" not in r.response.target_uri for r in nested)


# --- licenses


def test_licenses(spark):
    mit = dict((n, t) for n, t in licenses.TEMPLATES if n == "MIT")["MIT"]
    filler = "tako rimun saber iston grata " * 400
    docs = [
        (1, "Text here.\nLicensed under CC BY-NC 4.0.\nmore text"), (2, "Released under the MIT License.\n" + filler), (3, filler + "\n" + mit.replace("free of charge", "without any charge") + "\n" + filler),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "This work is licensed under the GNU General Public License, version 2."), (6, filler), (7, "a license to err and permission to go"),
        (8, ""), (9, None), (10, filler + "Licensed under the Apache License, Version 2.0 " + filler), (11, "Released under the MIT License.\n\n" + filler + "\nLicensed under CC BY 4.0."),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, LICENSES int")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(df).collect()}
    assert got == {1: ["CC-BY-NC-4.0"], 2: ["MIT"], 3: ["MIT"], 4: ["GPL-3.0"], 5: ["GPL-2.0"], 6: [], 7: [], 8: [], 9: [], 10: ["Apache-2.0"], 11: ["CC-BY-4.0", "MIT"]}
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_blocks_hold_every_cue():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["license ", "word ", "word\n", "copyright\n", "x" * 300 + " ", "\n\n"]) for _ in range(60))
        import re

        spans = licenses.blocks(text)
        assert all(any(a <= m.start() and m.end() <= b for a, b in spans) for m in re.finditer(licenses.CUE, text))
        assert spans == sorted(spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "        // ", " " * 30])
@pytest.mark.parametrize("width", [70, 74, 80])
def test_licenses_over_lines(mark, width):
    """Each template wrapped, behind comment marks and amid code."""
    import textwrap

    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(width)
    code = "\n".join("x%d = call(%d)" % (k, rng.randrange(99)) for k in range(200))
    for name, text in licenses.TEMPLATES:
        for lead in ("", "Some words come before it, and they move where the lines are broken: "):
            wrapped = "\n".join(mark + line for line in textwrap.wrap(lead + text, width))
            for whole in (wrapped, f"{code}\n{wrapped}\n{code}", f"{wrapped}\n{mark}\n{mark}Copyright of another text"):
                assert name in {m["license"] for m in scanner.scan(whole)}, (name, whole[:3000])


def test_licenses_in_one_block():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t) < 120 and n != "Unlicense"]
    six = [(n, t) for k, (n, t) in enumerate(short) if n not in {m for m, _ in short[:k]}][:6]
    assert {m["license"] for m in scanner.scan("\n".join(t for _, t in six))} == {n for n, _ in six} and len(six) == 6
    found = scanner.scan("\n".join(t for _, t in licenses.TEMPLATES * 30))
    assert {m["license"] for m in found} == {n for n, _ in licenses.TEMPLATES}
    assert sum(m["license"] == "Unlicense" for m in found) == 30


def test_alignments():
    """Against the plain edit distance of every part."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(1, 6)), rng.choices("abcde", k=rng.randint(0, 9))
        cost, begin = licenses.alignments(a, b)
        for hi in range(len(b) + 1):
            assert cost[hi] == min(edits(a, b[lo:hi]) for lo in range(hi + 1)) == edits(a, b[begin[hi] : hi])


# --- mixing


def test_poisson(spark):
    for rate in (0.3, 2.5, 30.0):
        n = spark.range(20_000).select(mixing.poisson(F.lit(rate), F.col("id").cast("string"), "t").alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert n[0] == pytest.approx(rate, rel=0.05) and n[1] == pytest.approx(rate, rel=0.08)


def test_mixed(spark, documents, empty, texts):
    out = mixing.mixed(documents, {"src0": 1.0, "": 1.0}, 3.0)
    again = mixing.mixed(documents.repartition(2), {"src0": 1.0, "": 1.0}, 3.0)
    assert rows(out) == rows(again) and out.columns == [*documents.columns, "copy", "mix_key"]
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys) and keys
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(documents, {}).count() == 0
    assert mixing.mixed(documents, {"other": 1.0}).count() == 0


def test_mixing_names(spark):
    """Names of the operator's own columns come back as they were; rows without id get counts and places of their own."""
    docs = [(k if k % 3 else None, f"text {k}", "ab"[k % 2], 9, 8, 7, 6.5, "s") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy int, mix_key int, _n int, rate double, _source string")
    out = mixing.mixture(df, {"a": 1.0, "b": 1.0}, 2.0)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(9, 8, 7, 6.5, "s")}
    full = mixing.mixed(df, {"a": 1.0, "b": 1.0}, 2.0)
    assert set(full.columns) == set(df.columns) and rows(full) == rows(mixing.mixed(df.repartition(7), {"a": 1.0, "b": 1.0}, 2.0))
    none = full.where("doc_id is null").groupBy("text").count().collect()
    assert 2 < len(none) < 100 and len({r["count"] for r in none}) > 1
    again = mixing.mixed(df.union(df), {"a": 1.0, "b": 1.0}, 2.0)
    assert rows(again) == listed([r for r in rows(full) for _ in range(2)])


def test_target_shares(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mixed(docs, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(22_500, rel=0.05) and n["b"] == pytest.approx(7_500, rel=0.05)


# --- tokens


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_tokens(spark, documents, texts, planes):
    """Against an untouched tokenizer, added tokens' names among the texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    more = [(7001, "a <|endoftext|> b"), (7002, "<|endoftext|>"), (7003, "x<|endoftext|>, y.\nz"), (7004, "日本語" * 5000), (7005, " ".join("日本" * k for k in range(60)))]
    texts = [*texts, *more]
    documents = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = tokens.token_table(documents, planes=planes).collect()
    assert len(out) == len(texts)
    want = {}
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(out, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in out), key=lambda x: (x is not None, x))


def test_tokens_of_nothing(empty):
    assert tokens.token_table(empty).collect() == []


def test_added_tokens_as_text(spark):
    t = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), special=False)
    assert 50256 in tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json")).encode("a <|endoftext|> b") and 50256 not in t.encode("a <|endoftext|> b")
    (r,) = tokens.token_table(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), special=False).collect()
    assert r.n_tokens == len(t.encode("a <|endoftext|> b")) + 1


@pytest.mark.parametrize("slots, ids, longest", [(16, 40, 12), (64, 200, 12), (64, 100_000, 64), (1 << 12, 20_000, 64)])
def test_pieces(monkeypatch, slots, ids, longest):
    """Ids from remembered pieces are those of whole texts, whatever the white space, also as the memory fills and is cleared."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SLOTS", slots)
    monkeypatch.setattr(tokens, "IDS", ids)
    monkeypatch.setattr(tokens, "LONGEST", longest)
    rng, path = random.Random(8), tokens.tokenizer_path("byte_bpe_50k.json")
    e, t = tokens.Encoder(path), Tokenizer.from_file(path)
    parts = ["the", "of", "don't", "x1y", "é", "...", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "!!", "12", "日本", "<|endoftext|>", "\0", "\x1c", "\u200b", "a.", "b,", "c.,", "1.", "x" * 70, ".", ",", ".a"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 12))) for _ in range(8)]
        assert [x.tolist() for x in e.texts(pa.array([*texts, None]))] == [*(t.encode(x, add_special_tokens=False).ids for x in texts), []]
    assert e.memory.used <= slots // 2 and e.memory.end <= ids


def test_memory_is_bounded_by_bytes():
    """Pieces of any number and length: the memory has its size from the start."""
    import pyarrow as pa

    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    size = lambda: sum(x.nbytes for x in (e.memory.keys, e.memory.at, e.memory.n, e.memory.ids))
    before = size()
    rng = random.Random(1)
    for _ in e.texts(pa.array(["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)) for _ in range(3000)])):
        pass
    assert size() == before <= 128_000_000 and e.memory.used == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files(tmp_path, planes, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 100)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 1 << 32, n, dtype=np.uint32)) for k, n in enumerate([0, 1, 99, 100, 101, 1000, 3])]
    w = tokens.Writer(f"file://{tmp_path}/x.planes", planes)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    r = tokens.Reader(f"file://{tmp_path}/x.planes")
    assert [(k, ids.tolist()) for k, ids in r.documents()] == [(k, ids.tolist()) for k, ids in docs]
    assert len(r.foot["chunks"]) == 14


# --- language and quality


def test_languages(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = langid.languages(docs.withColumn("lang_pred", F.lit(7)))
    held = out.where(langid.held_out())
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert out.where("score < 0 or score > 1").count() == 0 and out.columns.count("lang_pred") == 1


def test_languages_edges(spark, documents, empty):
    d = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa"))
    out = {r.doc_id: r.lang_pred for r in langid.languages(d).collect() if r.text is None or not any(c.isalpha() for c in r.text)}
    assert out and set(out.values()) == {"und"}
    assert {r.lang_pred for r in langid.languages(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(empty.withColumn("lang", F.lit("aa"))).count() == 0


def test_quality(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").where(langid.held_out())
    assert out.where("predicted = quality").count() >= 0.95 * out.count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_edges(spark, documents, empty, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.quality(documents, none).collect()} == {(0.5, 1)}
    some = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality(documents, some)
    assert out.count() == len(texts) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.quality(empty, some).count() == 0
    assert quality.accepted(documents, some).columns == documents.columns


def test_quality_is_learned_in_a_task(spark, documents, texts, monkeypatch):
    """Neither the sample's texts nor their matrix reach the driver, and the model is that of plain lists."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    known = sorted({(i, t) for i, t in texts if i is not None and i < 20 and t is not None and zlib.crc32(str(i).encode()) % 3 != 1})
    with monkeypatch.context() as driver:
        for name in ("decompose", "weighed"):
            driver.setattr(quality, name, lambda *a: pytest.fail("the driver learns"))
        got = quality.learn(documents, labels)
    want = quality.Model(got.idf, [t for _, t in known], [i % 2 for i, _ in known])
    assert got.labels.tolist() == want.labels.tolist() and got.prior == want.prior
    assert np.allclose(abs((got.vectors @ got.vectors.T)), abs(want.vectors @ want.vectors.T), atol=1e-3)


def test_exact_neighbours():
    """Blocked products and votes equal a plain loop's."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(rng.choices("abcde fgh", k=80)) for _ in range(60)]
    m = quality.Model(np.ones(quality.TRIGRAMS + quality.SHAPES), texts[:40], [k % 3 > 0 for k in range(40)])
    got = m.scores(pa.array([*texts, "", None]))
    for k, text in enumerate(texts):
        ((terms, counts),) = quality.term_counts(pa.array([text]))
        v = quality.weighed(terms, counts, m.idf) @ m.basis[terms]
        v = v / np.linalg.norm(v)
        near = sorted(((float(v @ u), y) for u, y in zip(m.vectors, m.labels)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0) ** quality.SHARP for c, _ in near]
        assert got[k] == pytest.approx(sum(a * y for a, (_, y) in zip(w, near)) / sum(w), abs=1e-3)
    assert got[-1] == got[-2] == m.prior


def test_languages_of_long_and_short_texts(spark, monkeypatch):
    """A language whose texts are all too long or too short is learned too; too many languages are an error."""
    words = {"mid": "alpha beta gamma delta", "long": "uno dos tres cuatro", "short": "eins zwei"}
    docs = [(k, lang, f"{words[lang]} " * (2000 if lang == "long" else 10) if lang != "short" else words[lang]) for k, lang in enumerate(["mid"] * 30 + ["long"] * 20 + ["short"] * 40)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    learned = langid.learn(df)
    assert list(learned) == ["short", "mid", "long"] and set(learned["long"].decode().split()) == set(words["long"].split())
    assert {(r.lang, r.lang_pred) for r in langid.languages(df).collect()} == {(x, x) for x in words}
    assert rows(langid.languages(df.union(df))) == listed([r for r in rows(langid.languages(df)) for _ in range(2)])
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.learn(df)


def test_many_languages(spark):
    """All of 300 languages are learned and told apart."""
    rng = random.Random(3)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12)] for k in range(300)}
    df = spark.createDataFrame([(i, lang, " ".join(rng.choices(w, k=60))) for i, (lang, w) in enumerate((x, w) for x, w in words.items() for _ in range(12))], "doc_id long, lang string, text string")
    assert langid.languages(df).where("lang <> lang_pred").count() == 0


def test_languages_by_plain_compression(spark, small):
    """Each verdict and score from the sizes that plain zstandard gives, without Spark or batches."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{small}/documents.parquet")
    learned = langid.learn(docs)
    zips = [(x, zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)) for x, d in learned.items()]
    got = langid.languages(docs).collect()
    for r in got:
        raw = (r.text or "").lower().encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        size = sorted((sum(len(z.compress(raw[k : k + langid.BLOCK])) for k in range(0, len(raw), langid.BLOCK)), n, x) for n, (x, z) in enumerate(zips))
        lead = (size[1][0] - size[0][0]) / max(size[0][0], 1)
        assert r.lang_pred == size[0][2] and r.score == pytest.approx(1 - math.exp(-lead / 0.02)) and r.rejected == (lead < langid.MARGIN)


def flipped(docs, labels):
    """The held-out rows' lang, source and labels changed."""
    held = langid.held_out()
    docs = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.when(held, F.lit("q")).otherwise(F.col("source")))
    return docs, labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))


def test_held_out_rows_teach_nothing(spark, small):
    """Verdicts stay the same whatever held-out rows say of themselves."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    docs_, labels_ = flipped(docs, labels)
    assert rows(langid.languages(docs).select("doc_id", "lang_pred", "score")) == rows(langid.languages(docs_).select("doc_id", "lang_pred", "score"))
    assert rows(quality.quality(docs, labels).select("doc_id", "score")) == rows(quality.quality(docs_, labels_).select("doc_id", "score"))
    assert rows(rules.quality_rules(docs, labels)) == rows(rules.quality_rules(docs_, labels_))
