from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import scoring, text
from quillstone.operators import filters as fl
from quillstone.operators import graph, search


def test_text(spark):
    rows = [("İstanbul ß a_b", ["i̇stanbul", "ß", "a", "b"]), ("...", []), (None, []), ("é" * 100, ["é" * 100])]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [b for _, b in rows]
    assert [r[0] for r in df.select(text.doc_len(F.col("t"))).collect()] == [len(b) for _, b in rows]
    clipped = spark.createDataFrame([("a" + "é" * 100,), ("ok",)], "t string").select(text.clip_term(F.col("t"))).collect()
    assert [r[0] for r in clipped] == ["a" + "é" * 63, "ok"]
    counts = spark.createDataFrame([(n,) for n in (0, 1, 510, 511, 956, 957)], "n int").select(text.chunk_count(F.col("n"))).collect()
    assert [r[0] for r in counts] == [1, 1, 1, 2, 2, 3]
    p = spark.createDataFrame([("a\nb",), ("x" * 97,), ("short",)], "t string").select(text.preview(F.col("t"))).collect()
    assert [r[0] for r in p] == ["a…", "x" * 96 + "…", "short"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(scoring.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(scoring.dot(F.col("v"), F.col("v"))).first()[0] == 25


def test_bm25_order(spark):
    docs = {11: "tide tables for the north harbour", 12: "harbour harbour tide harbour tide", 13: "a list of lamps", 14: "tide"}
    mem = spark.createDataFrame([(i, d, False, False, None, "") for i, d in docs.items()], "id long, content string, tombstone boolean, superseded boolean, project string, agent string")
    q = spark.createDataFrame([(0, "tide"), (1, "no such thing"), (2, "lamps harbour")], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in search.bm25_top_k(mem, q, 5, fl.keep()).collect()}
    # 16 tokens in 4 documents, so the mean length is 4; tide is in 3 documents, harbour in 2, lamps in 1
    part = lambda df, tf, size: math.log(1 + (4.5 - df) / (df + 0.5)) * 2.2 * tf / (tf + 0.3 + 0.9 * size / 4)
    want = {(0, 11): part(3, 1, 6), (0, 12): part(3, 2, 5), (0, 14): part(3, 1, 1), (2, 11): part(2, 1, 6), (2, 12): part(2, 3, 5), (2, 13): part(1, 1, 4)}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_terms_beyond_those_sent_are_joined(spark, monkeypatch):
    mem = spark.createDataFrame([(i, f"word{i} and more", False, False, None, "") for i in range(30)], "id long, content string, tombstone boolean, superseded boolean, project string, agent string")
    q = spark.createDataFrame([(i, f"word{i} more") for i in range(5)], "query_id long, text string")
    one = sorted(map(tuple, search.bm25_scores(mem, q, fl.keep()).collect()))
    monkeypatch.setattr(search, "TERMS_SENT", 2)
    assert sorted(map(tuple, search.bm25_scores(mem, q, fl.keep()).collect())) == one


lists_of_ids = st.lists(st.lists(st.integers(1, 30), max_size=10), min_size=1, max_size=3)


@settings(max_examples=8, deadline=None)
@given(lists_of_ids, st.integers(0, 12))
def test_fusion(spark, lists, k):
    frames = [spark.createDataFrame([(0, i, r) for r, i in enumerate(x)], "query_id long, id long, rank int") for x in lists]
    got = search.fuse(frames, k).orderBy("rank").collect()
    score, first = {}, {}
    for n, x in enumerate(lists):
        for r, i in enumerate(x):
            if i not in x[:r]:
                score[i] = score.get(i, 0) + 1 / (60 + r + 1)
                first.setdefault(i, (n, r))
    want = sorted(score, key=lambda i: (-round(score[i], 9), first[i]))[:k]
    assert [r.id for r in got] == want


def test_filters(spark):
    rows = [(1, {"n": fl.scalar(5), "s": fl.scalar("x")}), (2, {"n": fl.scalar(2.5)}), (3, {}), (4, {"n": fl.scalar(None)})]
    df = spark.createDataFrame(rows, f"id int, metadata map<string,{fl.SCALAR}>")
    ids = lambda f, on=df: [r.id for r in on.where(fl.all_match(f)).collect()]
    assert ids({"n": fl.Range(2, 5)}, df.where("id < 4")) == [1, 2] and ids({"s": fl.Eq("x")}) == [1] and ids({"zz": fl.Eq(1)}) == []
    assert ids({"a": fl.Eq(1), "n": fl.Eq("text")}) == []  # the first key fails, so the type of the second is not checked
    for bad in ({"n": fl.Eq("text")}, {"s": fl.Range(0, 1)}, {"n": fl.Eq(5)}):
        with pytest.raises(Exception, match="another type"):
            ids(bad)
    assert fl.parse_filters(["a=1", "b=1..2", "c>=3", "c<=9", "d=x", "e=true", "f=1.5"]) == {
        "a": fl.Eq(1), "b": fl.Range(1, 2), "c": fl.Range(3, 9), "d": fl.Eq("x"), "e": fl.Eq(True), "f": fl.Eq(1.5),
    }
    assert fl.parse_filters([" a =1_000", "b=2..", "c=..3"]) == {"a": fl.Eq("1_000"), "b": fl.Range(2, None), "c": fl.Range(None, 3)}
    for wrong in (["a"], ["a=1", "a=2"], ["a>=x"], ["=1"], ["a=.."], ["a>=1_0"], [" =1"]):
        with pytest.raises(ValueError):
            fl.parse_filters(wrong)
    assert fl.json_filter({"min": 1}) == fl.Range(1, None) and fl.python_filter((None, 2)) == fl.Range(None, 2)
    for wrong in ({}, {"low": 1}, [1], {"min": "x"}):
        with pytest.raises(ValueError):
            fl.json_filter(wrong)


def test_graph_checks(spark):
    edges = lambda *rows: spark.createDataFrame(rows, "src long, kind string, dst long")
    assert graph.checked_relations(edges((1, "a", 2), (1, "a", 2))).count() == 1
    for wrong in ((1, "a", 1), (1, "", 2), (1, "k" * 65, 2)):
        with pytest.raises(Exception, match="a relation takes"):
            graph.checked_relations(edges(wrong)).collect()
    with pytest.raises(Exception, match="an entity takes"):
        graph.checked_tags(spark.createDataFrame([("", 1)], "entity string, id long")).collect()
    chain = graph.newest_versions(edges((2, "supersedes", 1), (3, "supersedes", 2), (9, "other", 8))).collect()
    assert {(r.id, r.newest, r.steps) for r in chain} == {(1, 3, 2), (2, 3, 1)}
    long = graph.newest_versions(spark.range(1500).select((F.col("id") + 1).alias("src"), F.lit("supersedes").alias("kind"), F.col("id").alias("dst")))
    assert {(r.id, r.newest, r.steps) for r in long.collect()} == {(i, 1500, 1500 - i) for i in range(1500)}
    assert graph.newest_versions(edges((9, "other", 8))).count() == 0
    with pytest.raises(ValueError, match="circle"):
        graph.newest_versions(edges((1, "supersedes", 2), (2, "supersedes", 1)))


def test_vector_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    chunks = spark.createDataFrame([(i // 2, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)], "query_id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = search.vector_top_k(chunks, q, 3).collect()
    for i in range(5):
        best = np.round((u @ u[i]).reshape(100, 2).max(axis=1), 6)
        want = sorted(range(100), key=lambda r: (-best[r], r))[:3]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_later_batches_hand_on_only_what_can_count(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "ROWS_AT_ONCE", 16)
    rng = np.random.default_rng(8)
    ids, vecs, asked = np.repeat(np.arange(60), 5), np.round(rng.normal(size=(300, 4)), 1), search._unit(np.round(rng.normal(size=(7, 4)), 1).tolist())
    order = rng.permutation(300)  # chunks of a record lie in many batches
    batch = pa.RecordBatch.from_pydict({"id": ids[order], "vec": pa.array(vecs[order].tolist())})
    got = list(search._compare(SimpleNamespace(value=(np.arange(7), asked, [None] * 7)), 3, None, False, False)(iter([batch])))
    found = {}
    for b in got:
        for q, i, s in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            found.setdefault(q, {})[i] = max(s, found.get(q, {}).get(i, -2.0))
    scores = np.round(np.maximum.reduceat(asked @ search._unit(vecs.tolist()).T, np.arange(0, 300, 5), axis=1), 6)
    for q in range(7):
        best = lambda pairs: sorted(pairs, key=lambda x: (-x[1], x[0]))[:3]
        assert best(found[q].items()) == best(enumerate(scores[q].tolist()))
    assert sum(b.num_rows for b in got) < 7 * 3 * 19 / 2  # all 19 batches gave 3 a query before


def test_lift_asks_once_for_each_text_and_vector(spark, monkeypatch):
    keep, words = F.lit(True), ["red", "red", "blue", "blue green"]
    mem = spark.createDataFrame(list(enumerate(words)), "id long, content string")
    chunks = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, vec array<double>")
    cases = spark.createDataFrame([(i, w.split()[-1], [1.0, float(i % 2)]) for i, w in enumerate(words)], "query_id long, text string, vec array<double>")
    hits = lambda df: df.where("id = query_id").count()
    want = (4, hits(search.hybrid_recall(mem, chunks, cases, 1, keep)), hits(search.vector_top_k(chunks, cases, 1)))
    asked = []
    for name in ("vector_top_k", "bm25_top_k"):
        monkeypatch.setattr(search, name, lambda rows, queries, *a, f=getattr(search, name): asked.append(queries.count()) or f(rows, queries, *a))
    got = search.lift(mem, chunks, cases, 1, keep).first()
    assert (got.asked, got.hybrid_found, got.vector_found) == want and asked == [2, 3]
