"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prefloom.sources import readers as r, sinks

from .conftest import rows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_json(spark, tmp_path):
    at = put(tmp_path / "u.json", '{"id":"1","age":"30"}\n{"age":"4"}\n{"id":"1","age":"31"}\n')
    assert rows(r.reader("amazon", "user")(spark, at)) == [("1", "31", None)]
    at = put(tmp_path / "r.json", '{"u":"a","i":"b","r":"4.5","d":"10"}\n{"u":"a","i":"c","r":"x"}\n')
    assert rows(r.json_ratings(spark, at)) == [("a", "b", 4.5, 10), ("a", "c", None, None)]
    with pytest.raises(ValueError):
        r.reader("amazon", "shop")


def test_delimited(spark, tmp_path):
    at = put(tmp_path / "r.tsv", "a\tb\t4\t10\nshort\na\tc\t3\nd\te\t5\t7\tmore\nf\tg\n\nh\ti\tx\t\n")
    got = r.ratings_tsv(spark, at)
    want = [("a", "b", 4.0, 10), ("a", "c", 3.0, None), ("d", "e", 5.0, 7), ("h", "i", None, None)]
    assert rows(got) == want and got.count() == 4
    for k in range(1, 16):  # every subset of columns has the same rows
        columns = [c for i, c in enumerate(got.columns) if k >> i & 1]
        assert rows(got.select(*columns)) == sorted((tuple(w[got.columns.index(c)] for c in columns) for w in want), key=repr)
    at = put(tmp_path / "t.tsv", "1\t2\t0.5\textra\n1\t2\n3\t4\t1\n")
    assert rows(r.sparse_triples(spark, at)) == [(1, 2, 0.5), (3, 4, 1.0)]
    at = put(tmp_path / "o.tsv", "u\t2008-09-18 19:17:00\ti\t2\t9.5\tBaby & Kids|Toys, Games\n")
    assert rows(r.orders_tsv(spark, at)) == [("u", "i", 2, 9.5, "Baby&Kids|Toys Games", 1221765420)]
    at = put(tmp_path / "c.tsv", "7\tLeaf\t1\t/a/b\n")
    assert rows(r.category_tree(spark, at)) == [("7", "Leaf", True, ["a", "b"])]
    at = put(tmp_path / "m.dat", "1::Heat (1995)::Action|Crime\n")
    assert rows(r.movielens_items(spark, at)) == [("1", "Heat (1995)", ["Action", "Crime"])]


def test_sparse(spark, tmp_path):
    at = put(tmp_path / "f.csv", "2_a,1:0.5,7:2\n2_b\n")
    got = r.sparse_rows(spark, at)
    assert rows(got) == [("2_a", 1, 0.5), ("2_a", 7, 2.0)]
    assert rows(sinks.sparse_lines(got)) == [("2_a,1:0.5,7:2.0",)]


def test_libsvm(spark):
    df = spark.createDataFrame([(0.5, 1, [(7, 2.0), (1, 0.5)]), (1.0, 0, [])], "w double, label int, features array<struct<fid long, fval double>>")
    assert rows(sinks.libsvm_lines(df.limit(1), weight="w")) == [("0.5 1 1:0.5 7:2.0",)]
    assert rows(sinks.coordinates(df.withColumn("k", F.col("label")), "k")) == [(1, 1, 0.5), (1, 7, 2.0)]


def test_training_log(spark, tmp_path):
    at = put(tmp_path / "log", "noise\niteration:3,time:1.5,train rmse:0.9,test rmse:1.01,cs rmse:nan\n")
    got = r.training_log(spark, at).first()
    assert (got.iteration, got.time, got.train_rmse, got.test_rmse) == (3, 1.5, 0.9, 1.01)


def test_documents(spark):
    d = spark.range(1).select(sinks.trec(F.col("id"), F.lit("t")).alias("x"), sinks.banner(F.array(F.lit("a"), F.lit("b")), 1).alias("y")).first()
    assert d.x == "<DOC>\n<DOCNO>0</DOCNO>\n<TEXT>\nt\n</TEXT>\n</DOC>" and d.y == "<ul><li>a</li></ul>"


def test_lines(spark, tmp_path):
    """Lines keep their order over files and splits."""
    lines = [f"line {k} " + "x" * (k % 50) for k in range(2000)]
    put(tmp_path / "a.txt", "\n".join(lines[:1500]) + "\n")
    put(tmp_path / "b.txt", "\n".join(lines[1500:]) + "\n")
    index = put(tmp_path / "index", "1\n1500\n1501\n2000\n2000\n3000\nno\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        paths = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]
        assert rows(r.numbered_lines(spark, paths)) == sorted(((k + 1, line) for k, line in enumerate(lines)), key=repr)
        assert rows(r.rows_at(spark, paths, index)) == sorted([(k, lines[k - 1]) for k in (1, 1500, 1501, 2000)], key=repr)
        many = put(tmp_path / "p.json", "".join('{"id":"%d","c":"%d", "m": null}\n' % (k % 7, k) for k in range(3000)))
        assert {x.id: x.c for x in r.reader("amazon", "item")(spark, many).collect()} == {str(k % 7): str(k) for k in range(2993, 3000)}
        assert {x.id: x.line for x in r.item_lines(spark, many).collect()} == {str(k % 7): '{"id":"%d","c":"%d", "m": null}' % (k % 7, k) for k in range(2993, 3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_deep_tree(spark):
    from prefloom.operators.graph import ancestors

    chain = [(k, f"n{k}", k - 1 if k else None) for k in range(100)] + [(500, "lone", 999)]
    got = {x.node: x.path for x in ancestors(spark.createDataFrame(chain, "node long, name string, parent long")).collect()}
    assert got == {k: "/".join(f"n{i}" for i in range(k + 1)) for k in range(100)} | {500: "lone"}
    with pytest.raises(ValueError):
        ancestors(spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "node long, name string, parent long"))


def test_sparse_vectors(spark):
    """Vectors cost their features, and no id leaves."""
    from prefloom.models.linear import vectorized

    df = spark.createDataFrame([(0, [(7, 2.0), (1, 0.5)]), (1, []), (1, [(50_000_000, 3.0)])], "label int, features array<struct<fid long, fval double>>")
    got = [x.vector for x in vectorized(df, 10).orderBy("label", "features").collect()]
    assert all(v.size == 50_000_000 for v in got)
    assert sorted((list(v.indices), list(v.values)) for v in got) == [([], []), ([0, 6], [0.5, 2.0]), ([49_999_999], [3.0])]
