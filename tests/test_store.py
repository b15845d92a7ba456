from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.functions.embed import HashingEmbedder, PrecomputedEmbedder
from quillstone.operators import filters as fl
from quillstone.operators import search
from quillstone.plans.tools import Tools
from quillstone.sources import oplog, project, synthetic
from quillstone.sources.store import Draft, Store, WriteLocked, check_ids, new_id
from quillstone.streaming import oplog as stream

#: Topics of a kitchen notebook; each has an axis, and its words mean the same.
TOPICS = ["soup broth stew bouillon", "bread loaf", "oven", "salt brine"]


def topics():
    """An embedder that counts the words of each topic; made here, as workers cannot import this module."""
    groups = [x.split() for x in TOPICS]

    class Topics:
        id, dims = "topics", len(groups)

        def embed(self, texts: pd.Series) -> pd.Series:
            counts = [np.array([sum(text.lower().split().count(w) for w in g) for g in groups], dtype=float) for text in texts.fillna("")]
            return pd.Series([(c / max(np.linalg.norm(c), 1e-12)).tolist() for c in counts])

    return Topics()


def test_store_life(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    a, b, c = store.remember(
        Draft("the soup needs bread", "p", "cli", metadata={"stars": 5, "topic": "ops"}, entities=["soup"]), Draft("brine for the fish", "p", "cli", entities=["salt"]), Draft("oven notes", None, "cli")
    )
    hits = store.recall("loaf broth", limit=2)
    assert hits[0].id == a.id and len(hits) == 2  # found by meaning alone
    assert [r.id for r in store.recall("brine", limit=1)] == [b.id]
    assert {r.id for r in store.recall("soup", project="p")} == {a.id, b.id}
    assert [r.id for r in store.recall("soup", filters={"stars": fl.Range(low=4)})] == [a.id]
    with pytest.raises(Exception, match="another type"):
        store.recall("soup", filters={"stars": fl.Eq("five")})
    again = store.remember(Draft("the soup needs bread now", "p", "cli", relations=[("about", b.id)], supersedes=[a.id]), similar=True)[0]
    assert [r.id for r in again.similar] == [a.id]
    assert [(r.kind, r.other, r.outgoing) for r in store.related(again.id)] == [("about", b.id, True), ("supersedes", a.id, True)]
    assert a.id not in {r.id for r in store.recall("soup bread")} and store.get(a.id) is not None
    near = store.recall("bread soup", limit=1, expand_related=True)
    assert [r.section for r in near] == ["hit", "related"] and near[1].id == b.id and near[1].score == 0
    with pytest.raises(Exception, match="own project"):
        store.remember(Draft("x", "q", supersedes=[b.id]))
    with pytest.raises(ValueError, match="no live memory"):
        store.remember(Draft("x", relations=[("about", "nobody")]))
    assert store.forget(b.id) and not store.forget(b.id) and store.get(b.id) is None
    assert store.entity_members("salt") == [] and store.entities_of(a.id) == ["soup"]
    before = store.stats()
    assert (before["live"], before["forgotten"]) == (3, 1)
    store.vacuum()
    after = store.stats()
    assert (after["live"], after["forgotten"], after["relations"]) == (3, 0, 1)
    assert [r.id for r in store.timeline().collect()] == sorted([a.id, c.id, again.id])
    with pytest.raises(ValueError, match="made with"):
        Store(spark, str(tmp_path / "s"), HashingEmbedder(), create=False)
    (tmp_path / "s/LOCK").touch()
    with pytest.raises(WriteLocked):
        store.vacuum()
    (tmp_path / "s/LOCK").unlink()
    with pytest.raises(FileExistsError):
        Store(spark, str(tmp_path / "s"), create=True)
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "other"), create=False)


def test_near_copy_in_a_later_window(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    kept = store.remember(Draft("oven notes", "p"), Draft("bread", "p"), Draft("oven", "q"))[0]
    draft = store.remember(Draft("salt " * 446 + "oven " * 200, "p"), similar=True)[0]
    assert [(r.id, r.score) for r in draft.similar] == [(kept.id, 1.0)]  # once, by the second window; the first has 0.14


def test_each_half_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    a, b, c = store.remember(Draft("soup soup salt", "p"), Draft("soup", "p"), Draft("stew", "q"))
    assert [r.id for r in store.search_text("soup")] == [a.id, b.id] or [r.id for r in store.search_text("soup")] == [b.id, a.id]
    assert store.search_text("broth") == [] and {r.id for r in store.recall_vector("broth", limit=2)} == {b.id, c.id}
    assert [r.id for r in store.recall_vector("broth", project="q")] == [c.id]
    ties = store.remember(*[Draft("bread", "t") for _ in range(4)])
    assert [r.id for r in store.recall("bread", project="t", limit=3)] == sorted(r.id for r in ties)[:3]


def test_stored_postings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    a, b, c, d = store.remember(Draft("Soup soup salt", "p"), Draft("soup and bread", "p"), Draft("oven", "q"), Draft("", "q"))
    store.remember(Draft("salt on bread " + "x" * 200, "p"))
    asked = spark.createDataFrame([(0, "soup salt"), (1, "bread oven oven"), (2, "nothing")], "query_id long, text string")

    def same() -> list:
        mem, now = store.table("memories"), store._now()
        stored = [sorted(map(tuple, x.select("id", "term", "tf", "doc_len").collect())) for x in (store.table("postings"), search.term_rows(mem))]
        assert stored[0] == stored[1] and search.corpus_stats(mem).first().asDict() == {k: now[k] for k in ("n_docs", "total_tokens")}
        for keep in (fl.keep(), fl.keep("p")):
            by_index, by_text = (sorted(map(tuple, search.bm25_top_k(mem, asked, 3, keep, x).collect())) for x in (store._index(now), None))
            assert by_index == by_text and by_text
        return by_text

    first = same()
    assert store.forget(b.id)
    marked = same()
    store.vacuum()
    assert first != marked != same()  # statistics hold the forgotten until they are vacuumed
    assert store.get(d.id).content == ""


def test_postings_of_many_terms(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    a, b = store.remember(Draft("soup salt"), Draft("bread"))
    few = store.search_text("soup salt oven")
    monkeypatch.setattr(search, "TERMS_PUSHED", 1)
    assert store.search_text("soup salt oven") == few and [r.id for r in few] == [a.id]


def test_writes_append(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), topics(), create=True)
    a = store.remember(Draft("soup", entities=["pot"]))[0]
    before = store._now()["tables"]
    store.forget(a.id)
    now = store._now()["tables"]
    assert {t for t in now if now[t] != before[t]} == {"marks"}
    b = store.remember(Draft("bread"))[0]
    later = store._now()["tables"]
    assert {t: f[:-1] for t, f in later.items() if f != now[t]} == {t: now[t] for t in ("memories", "chunks", "postings")}
    monkeypatch.setattr("quillstone.sources.store.FOLDERS", 3)
    monkeypatch.setattr("quillstone.sources.store.FOLDED", 2)
    more = [store.remember(Draft(f"salt {i}"))[0].id for i in range(4)]
    assert max(map(len, store._now()["tables"].values())) <= 3 and store.version == 8 - 1
    assert [r.id for r in store.timeline().collect()] == [b.id, *more] and len(store.search_text("salt")) == 4
    store.vacuum()
    assert max(map(len, store._now()["tables"].values())) == 1 and store.table("memories").count() == 5


def test_lock_of_an_ended_writer(spark, tmp_path):
    import socket
    import subprocess

    store = Store(spark, str(tmp_path / "s"), create=True)
    ended = subprocess.Popen(["true"])
    ended.wait()
    (tmp_path / "s/LOCK").write_text(f"{socket.gethostname()} {ended.pid}")
    store.vacuum()
    (tmp_path / "s/LOCK").write_text(f"elsewhere {ended.pid}")
    with pytest.raises(WriteLocked):
        store.vacuum()


def test_known_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), PrecomputedEmbedder("two", {"alpha": [1.0, 0.0], "beta": [0.0, 1.0]}))
    a, _ = store.remember(Draft("alpha"), Draft("beta"))
    assert store.recall_vector("alpha", limit=1)[0].id == a.id
    with pytest.raises(Exception, match="no vector"):
        store.recall_vector("gamma")


def test_command_line(spark, tmp_path):
    ask = lambda *words: cli.run(spark, ["--store", str(tmp_path / "s"), "--project", "p", *words])
    code, one = ask("remember", "salt the broth", "--entity", "soup", "--meta", "stars=4")
    assert code == 0
    assert [h["id"] for h in ask("recall", "broth", "--filter", "stars>=3")[1]["hits"]] == [one["id"]]
    assert ask("recall", "broth", "--filter", "stars>=5")[1]["hits"] == [] and ask("recall", "broth", "--filter", "stars=..")[0] == 1
    assert ask("related", one["id"])[1]["entities"] == ["soup"] and ask("forget", "bogus")[0] == 1
    assert ask("forget", one["id"])[1]["forgotten"] and ask("vacuum")[0] == 0 and ask("stats")[1]["live"] == 0
    assert [cli.human_bytes(n) for n in (0, 1023, 1536, 5 << 30)] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]


def test_half_written_snapshot_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), create=True)
    store.remember(Draft("kept"))
    import os

    monkeypatch.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.remember(Draft("lost"))
    monkeypatch.undo()
    assert [r.content for r in store.timeline().collect()] == ["kept"]
    store.remember(Draft("later"))
    assert [r.content for r in store.timeline().collect()] == ["kept", "later"]


def test_tools_and_log(spark, tmp_path):
    log = str(tmp_path / "log")
    tools = Tools(Store(spark, str(tmp_path / "s")), project="p", log=log)
    one = tools.call("remember", {"content": "alpha beta"})
    assert not one["isError"]
    assert [h["id"] for h in tools.call("recall", {"query": "alpha"})["hits"]] == [one["id"]]
    assert tools.call("recall", {"query": "alpha", "project": None})["isError"] and tools.call("fly", {})["isError"]
    assert tools.call("related", {"id": one["id"]})["related"] == [] and tools.call("forget", {"id": one["id"]})["forgotten"]
    typed = tools.call("remember", {"content": "gamma", "metadata": {"n": 1}})
    wrong = tools.call("recall", {"query": "gamma", "filters": {"n": "one"}})
    assert not typed["isError"] and wrong["isError"] and "another type" in wrong["error"]
    assert tools.call("forget", {"id": "bogus"})["isError"] and tools.call("related", {"id": "bogus"})["isError"]
    hit = tools.call("recall", {"query": "gamma"})["hits"][0]
    assert (hit["project"], hit["agent"], hit["superseded"]) == ("p", "tools", False) and hit["created_us"] > 0
    (tmp_path / "file").touch()
    with pytest.warns(UserWarning, match="not written"):
        blocked = Tools(tools.store, log=str(tmp_path / "file"))
    with pytest.warns(UserWarning, match="not written"):
        assert not blocked.call("stats", {})["isError"]
    ops = oplog.read(spark, log)
    figures = tools.store.report(ops)
    assert (figures["sessions"], figures["recalls"], figures["recall_errors"], figures["remembers"], figures["forgets"], figures["related"]) == (1, 4, 2, 2, 1, 2)
    assert figures["top"] == [{"id": one["id"], "served": 1, "preview": "(forgotten since)"}, {"id": typed["id"], "served": 1, "preview": "gamma"}] and figures["never_recalled"] == 0


def test_bad_log_lines(spark):
    good = json.dumps({"ts": 5, "tool": "recall", "ids": ["a"], "latency_ms": 1.5})
    lines = spark.createDataFrame([(x,) for x in (good, "{not json", "", good.replace("5", "1", 1))], "value string")
    assert oplog.skipped(lines).first().skipped_lines == 1
    assert oplog.parse(lines).count() == 2 and oplog.parse(lines, since=3).count() == 1


def test_stream_of_operations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": 1_700_000_000_000_000 + i * 60_000_000, "tool": "recall" if i % 2 else "remember", "ids": [], "latency_ms": float(i), "isError": i == 3} for i in range(10)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.usage_by_window(stream.tail(spark, str(tmp_path / "in")), "1 day").writeStream.format("memory").queryName("usage_w").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.table("usage_w").agg(F.sum("operations"), F.sum("recalls"), F.sum("errors")).first()
    finally:
        q.stop()
    assert tuple(got) == (10, 5, 1)


def test_ids_projects_and_corpora(spark, tmp_path):
    assert new_id(1) < new_id(2) and check_ids([new_id(), "x", "Z" * 26], spark) == ["x", "Z" * 26]
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/a").mkdir()
    assert project.detect_project(tmp_path / "repo/a") == "repo"
    (tmp_path / "repo/.quillstone.toml").write_text('# x\nproject = "named" # y\n')
    assert project.detect_project(tmp_path / "repo/a") == "named" and project.parse_project("[t]\nproject='x'") is None
    for make in (synthetic.corpus, synthetic.session_corpus, synthetic.duplicate_pairs, synthetic.lexical_cases):
        one, two = (make(spark, 7, 50).collect() for _ in range(2))
        assert one == two and len(one) == 50 and one != make(spark, 8, 50).collect()
