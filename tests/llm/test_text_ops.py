"""Tokens, pieces, sharding, mixing, rules, scores: against brute force on small tables with odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import class_lm, jaccard_join, line_dedup, mixing, pieces, quality, rules, sharding, simple8b, token_ids

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "the cat sat on the mat " * 10, "a"), (2, "", "a"), (3, None, "b"), (4, "the cat sat on the mat " * 10, "b"), (5, "   \n\t ", None), (6, "ÀÉ ß 日本 İx " * 30, "b"),
    (7, "one\ntwo\none\n\none", "c"), (None, "no id here", "c"), (8, "w" * 5000 + " x", "a"), (8, "w" * 5000 + " x", "a"), (9, "don't <|endoftext|> #$% a|b", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int").repartition(3).cache()  # clashing names besides


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def check_shards(rows, shards, tolerance):
    sizes = Counter()
    for s in range(shards):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    assert max(sizes.values()) - min(sizes.values()) <= tolerance


def test_sharding(spark, odd, none, docs):
    got = sharding.shard_by_size(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in text.items()}
    check_shards(got, 8, 2 * max(r["size"] for r in got))
    where = {}
    assert all(where.setdefault((r["size"], r.text_crc32), r.shard) == r.shard for r in got)  # equal texts stay together where they fit
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_by_size(docs.repartition(7)).collect()), key=str)
    check_shards(sharding.shard_by_size(odd).collect(), 8, 10_010)  # two rows of one id and text lie together
    assert len(sharding.shard_by_size(odd).collect()) == len(ODD) and sharding.shard_by_size(none).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    hot_rows = sharding.shard_by_size(hot, ranges=256).collect()
    check_shards(hot_rows, 8, sum(r["size"] for r in hot_rows) / 8 * 0.05)


def test_pack_splits_only_what_does_not_fit():
    where = sharding.pack([(10 + i, 10) for i in range(20)], [(1, [(0, 100), (1, 100), (2, 100)]), (2, [(3, 40), (4, 40)])], 4)
    assert where[3] == where[4] and len({where[0], where[1], where[2]}) > 1 and set(where) == {*range(5), *range(10, 30)}


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 4095, 4096, 4097, 9000):
        for top in (0, 1, 2, 300, 49_408, 65_536, 1 << 59, 1 << 60, (1 << 64) - 1):
            v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            v[n // 3 : n // 2] = 0
            words, offsets, escapes = simple8b.encode(v)
            assert (simple8b.decode(words, offsets, escapes, n) == v).all()
            if n > simple8b.BLOCK:  # the second block alone
                one = simple8b.decode(words[offsets[1] : offsets[2] if len(offsets) > 2 else None], np.zeros(1, np.int64), escapes, min(n - simple8b.BLOCK, simple8b.BLOCK))
                assert (one == v[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()


def test_token_ids(spark, odd, none, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for n, table in enumerate((docs, odd, none)):
        out = str(tmp_path / str(n))
        token_ids.write_ids(table, out, path)
        got = token_ids.read_ids(spark, out).join(token_ids.segment_starts(spark, out), ["part", "segment"]).withColumn("start", F.col("segment_start") + F.col("ids_at")).orderBy("start").collect()
        want = sorted(((r.doc_id, np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted((i or -1, b) for i, b in want)
        assert [r.doc_id for r in got] == [i for i, _ in want]
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) // 4
            at += r.n_tokens


def test_token_ids_of_every_letter_before_a_sign():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [f"a{chr(c)}. {chr(c)}a!{chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    got = token_ids.encode_texts(texts, path)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    rng = np.random.default_rng(3)
    signs = [*"abcXYZ.,;:!?'\"()<|>-_ \n\t09", "\u0130", "\u0915\u093c", "\u0958", "\u0301", "\u00e9", "\u65e5", "\u00b2", "\u1100", "\u1161"]
    mixed = ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(mixed, add_special_tokens=False)]
    assert token_ids.encode_texts(mixed, path) == want


def test_words_that_differ_by_case_and_signs_are_learnt_once():
    import public_tokenizers

    coder = token_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Word, word.\nWORD  word,", "", " ", "<|endoftext|> Word, H\u0331, Ab\u0301c. \u00c9t\u00e9, it's, 'S x<|", "\u00c4B, \u4e2d, \u0130. \u03a3"]
    assert coder.texts(texts[:1]) == [coder.ids(texts[0])]
    assert set(coder.known) == {b"", b"word", b",", b"."}
    assert coder.texts(texts) == [coder.ids(t) for t in texts] == [coder.texts([t])[0] for t in texts]


def test_pieces(spark, odd, none, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    more = spark.createDataFrame([(20, " leading  two   spaces "), (21, "▁mark"), (22, "a" * 300), (23, "1234 x_y"), (24, "tab\tline\r\n\n")], "doc_id long, text string")
    for table in (docs, odd, more):
        texts = {(r.doc_id, r.text) for r in table.collect()}
        got = pieces.encode(table, path).collect()
        assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((r.doc_id or -1, sp.encode(r.text or "")) for r in table.collect())
        back = {(r.doc_id, r.text) for r in pieces.decode(spark.createDataFrame(got), path).collect()}
        assert back == {(i, (t or "").replace("▁", " ")) for i, t in texts}
    assert pieces.encode(none, path).count() == 0


def test_pieces_of_what_lies_between_spaces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, coder, decoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Chunks(pieces.Segments(path, [])), pieces.Decoder(path)
    texts = ["", " ", "a", " a", "a ", "the end.\nthe end, 12\u00b2 \u00e9t\u00e9", "two  spaces", "\u2581a b", "b\u2581 c", "it's\n it's\t\u4e2d_x"]
    coded = [coder.ids(t) for t in texts]
    assert [np.frombuffer(c, dtype="<u4").tolist() for c in coded] == [library.encode(t) for t in texts]
    assert list(decoder.texts(coded)) == [decoder.text(library.encode(t)) for t in texts]
    assert set(coder) >= {"the", "end.\nthe", "end,"} and pieces.chunks_of("two  spaces", coder.known.model) is None


def test_lattice_gives_the_boundaries(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    words = sorted({w for r in docs.limit(40).collect() for w in pieces.words_of(r.text, model) if 1 < len(w) <= pieces.LONGEST})
    got = {r.word: r.bounds for r in pieces.segment(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), path).collect()}
    assert len(got) > 0.9 * len(words)
    for w, bounds in got.items():
        at = [i for i in range(len(w) + 1) if bounds >> i & 1]
        assert [w[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == pieces.merge_long(w, model)


def test_viterbi_on_a_unigram_model(spark, monkeypatch):
    scores = {"a": -3.0, "b": -3.0, "c": -3.5, "ab": -4.0, "bc": -3.8, "abc": -8.0, "ca": -5.0}
    model = pieces.PieceModel(pieces.UNIGRAM, {p: i for i, p in enumerate(scores)}, list(scores.values()), list(scores), {}, 0, False, 3, re.compile(r"\w+"))
    monkeypatch.setattr(pieces, "load", lambda path: model)
    words = ["abc", "abca", "bcab", "aabbcc", "xab", "cabcab", "ba"]
    got = {r.word: r.bounds for r in pieces.segment(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), "none").collect()}
    for w, bounds in got.items():
        at = [i for i in range(len(w) + 1) if bounds >> i & 1]
        value = lambda parts: sum(scores.get(p, -18.0) for p in parts)
        assert value([w[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]) == value(pieces.best_long(w, model))
    assert set(got) == {w for w in words if any(p in w for p in scores if len(p) > 1)}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12  # a source gets min(most * size, level * weight); find the level
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * sizes[s], level * weight[s]) for s in names) > share * sum(sizes.values()):
            high = level
        else:
            low = level
    return {s: min(most * sizes[s], low * weight[s]) for s in names}


def test_mixing(spark, odd, none, docs):
    for table in (docs, odd):
        got = mixing.mix(table.withColumn("sources", F.array("source"))).collect()
        assert len(got) == table.count()
        sizes = Counter()
        for r in table.collect():
            sizes[r.source] += len(words_of(r.text))
        want = brute_targets(sizes)
        assert Counter(r["size"] for r in got) == Counter(len(words_of(r.text)) for r in table.collect())
        for s in sizes:
            own = [r for r in got if r.pattern == [s]]
            assert own[0].source_sizes == [sizes[s]] and abs(own[0].targets[0] - want[s]) < 1e-3
            assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1
            if len(own) > 30:
                assert abs(sum(r.taken for r in own) - want[s]) <= 0.01 * want[s] + 2
            assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
    again = mixing.mix(docs.repartition(5).withColumn("sources", F.array("source"))).collect()
    first = mixing.mix(docs.withColumn("sources", F.array("source"))).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in first}
    assert mixing.mix(none.withColumn("sources", F.array("source"))).count() == 0
    rows = mixing.take(docs)
    assert rows.columns == docs.columns and Counter(r.doc_id for r in rows.select("doc_id").collect()) == Counter({r.doc_id: r.taken // r["size"] for r in first if r.taken})


def test_flow_decides_every_quota(spark, docs, monkeypatch):
    asked = []
    cheapest = mixing._cheapest
    monkeypatch.setattr(mixing, "_cheapest", lambda supply, *a: asked.extend(supply) or cheapest(supply, *a))
    got = mixing.mix(docs.withColumn("sources", F.array("source"))).collect()
    assert set(asked) == {tuple(r.pattern) for r in got}


def test_filling_comes_as_near_as_can_be():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes, left = rng.integers(1, 40, rng.integers(0, 8)).tolist(), float(rng.integers(0, 90)) / 2
        sums = {sum(x for i, x in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))}
        assert abs(sum(sizes[i] for i in mixing.fill(left, sizes)) - left) == min(abs(s - left) for s in sums)
    assert mixing.fill(1e9, [10**9 // 2, 10**9 // 2 + 7]) == [0, 1]


def test_columns_of_any_name_survive(spark):
    names = ["key", "row", "number", "uses", "use", "_key", "_number", "_uses", "doc_key", "drop_at", "_text", "text_key", "a.b", "n_chars"]
    table = spark.createDataFrame([(i, f"some words of text {i}\nand one line for all", "s", *range(len(names))) for i in (1, 2, 2)], ["doc_id", "text", "source", *names])
    taken = mixing.take(table)
    assert taken.columns == table.columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in taken.collect())
    kept = line_dedup.keep_lines(table)
    assert kept.columns == table.columns and all(tuple(r)[3:-1] == tuple(range(len(names) - 1)) and r.n_chars == len(r.text) for r in kept.collect())
    alone = jaccard_join.keep_one(table)
    assert alone.columns == table.columns and sorted(r.doc_id for r in alone.collect()) == [1, 2] and all(tuple(r)[3:] == tuple(range(len(names))) for r in alone.collect())


def test_flow_uses_fresh_words_first():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 18.0, "b": 10.0}, 2)
    used = {p: sum(f.values()) for p, f in flow.items()}
    assert abs(sum(f.get("a", 0) for f in flow.values()) - 18) < 1e-6 and abs(sum(f.get("b", 0) for f in flow.values()) - 10) < 1e-6
    assert max(used.values()) <= 10 + 1e-6  # nobody is used twice while words are left
    twice = mixing.route({("a",): 10, ("b",): 5}, {"a": 15.0, "b": 20.0}, 2)
    assert twice == {("a",): {"a": 15.0}, ("b",): {"b": 10.0}}


def test_rules(spark, odd, none, docs):
    for table in (docs, odd):
        got = rules.judge(table).collect()
        want = []
        for r in table.collect():
            w = words_of(r.text)
            at = {}
            for i in range(len(w) - 2):
                at.setdefault(tuple(w[i : i + 3]), []).append(i)
            repeat = len({p + j for ps in at.values() if len(ps) > 1 for p in ps for j in range(3)})
            lines = [x for x in (r.text or "").split("\n") if words_of(x)]
            n = len(w)
            want.append((r.doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n))
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    judged = rules.judge(docs).collect()
    kept = Counter(tuple(r) for r in rules.keep(docs).select("doc_id", "text").collect())
    assert kept == Counter((r.doc_id, r.text) for r in docs.collect() if {j.doc_id: j.kept for j in judged}[r.doc_id])
    assert rules.keep(docs).columns == docs.columns and rules.judge(none).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "too short", "bad") for i in range(200)] + [(1000 + i, good, f"good{i % 5}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in rules.judge(table).where("kept").collect()} == set(range(1000, 1200))
    assert {r.doc_id for r in rules.keep(table).collect()} == set(range(1000, 1200))


def test_class_lm(spark, odd, none, docs):
    held = class_lm.held_out(7, 2)
    for table in (docs, odd):
        got = class_lm.score(table, table.where(~held), held).collect()
        counts, rows = Counter(), []
        for r in table.collect():
            w = re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower()) + [b""]
            out = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 7 == 2
            rows.append((r.doc_id, out, w))
            if not out:
                counts.update(w)
        total, types = sum(counts.values()), len(counts)
        key = lambda x: str(x[:5])
        want = sorted(((i, o, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w)) for i, o, w in rows), key=key)
        have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
        assert [x[:5] for x in have] == [x[:5] for x in want] and all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(have, want, strict=True))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in class_lm.score(docs, docs.where(~held), held).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out texts are more likely than word by word
    assert class_lm.score(none, none, held).count() == 0
    assert all(math.isfinite(r.score) for r in class_lm.score(odd, none, held).collect())


def test_class_model_is_a_distribution(spark, docs):
    model, _, totals = class_lm.fit(docs, lexicon=3000, core=100, classes=10)
    assert np.allclose((10**model.moves).sum(axis=1), 1)
    in_class = np.bincount(model.classes, weights=10**model.emits, minlength=model.n_classes)
    assert np.allclose(in_class[np.bincount(model.classes, minlength=model.n_classes) > 0], 1)


def test_class_scores_by_brute_force(spark, docs):
    held, sizes = class_lm.held_out(7, 2), {"lexicon": 500, "core": 50, "classes": 8}
    some = docs.limit(60).cache()
    train = some.where(~held)
    model, _, _ = class_lm.fit(train, **sizes)
    klass = {w: int(model.classes[i]) for w, i in model.ids.items()}
    texts = [class_lm.words_of(r.text) for r in train.collect()]
    counts = Counter(w for t in texts for w in t)
    end, other = model.n_classes, model.n_classes + 1

    def path(words):
        state, out = end, []
        for w in [*words, None]:
            now = end if w is None else klass.get(w, other)
            out.append((state, now, w))
            if now != other:
                state = now
        return out

    moves = Counter((s, c) for t in texts for s, c, _ in path(t))
    total, k = sum(moves.values()), model.n_classes + 2
    arrived, left, in_class = Counter(), Counter(), Counter()
    for (s, c), n in moves.items():
        arrived[c] += n
        left[s] += n
    for w, c in klass.items():
        in_class[c] += counts[w]
    opened = {w: n for w, n in counts.items() if w not in klass}
    spread = sum(opened.values()) + len(opened) + 1

    def brute(words):
        out = 0.0
        for s, c, w in path(words):
            out += math.log10((moves[s, c] + class_lm.PRIOR * (arrived[c] + 1) / (total + k)) / (left[s] + class_lm.PRIOR))
            if c == other:
                out += math.log10((opened.get(w, 0) + 1) / spread)
            elif w is not None:
                out += math.log10(counts[w] / in_class[c])
        return out

    got = {r.doc_id: r.score for r in class_lm.score(some, train, held, **sizes).collect()}
    for r in some.collect():
        assert abs(got[r.doc_id] - brute(class_lm.words_of(r.text))) < 1e-6 * max(1, abs(got[r.doc_id]))


def test_words_outside_the_core_are_exchanged_too(spark):
    rng = np.random.default_rng(8)
    sides = [[f"{s}{i}" for i in range(60)] for s in "ab"]
    texts = [" ".join(str(sides[j % 2][min(59, rng.geometric(0.05) - 1)]) for j in range(40)) for _ in range(400)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, _, _ = class_lm.fit(train, core=12, classes=2)
    assert len(model.ids) > 100 and len({(w[:1], int(model.classes[i])) for w, i in model.ids.items()}) == 2


def test_gains_agree_with_the_likelihood():
    rng = np.random.default_rng(9)
    pairs, of = rng.integers(0, 6, (12, 12)), rng.integers(0, 3, 12)

    def bigrams(of):
        one = np.eye(3)[of]
        return one.T @ pairs @ one

    def likely(m):
        g = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v > 0)
        return g(m) - g(m.sum(axis=0)) - g(m.sum(axis=1))

    one = np.eye(3)[of]
    alone = pairs - np.diag(np.diag(pairs))
    got = class_lm.gains(bigrams(of), of, alone @ one, alone.T @ one, np.diag(pairs).astype(float))
    for w in range(12):
        want = [likely(bigrams(np.where(np.arange(12) == w, c, of))) for c in range(3)]
        assert np.allclose(got[w] - got[w][0], np.array(want) - want[0])


def test_exchange_finds_the_planted_classes():
    rng = np.random.default_rng(3)
    truth = np.arange(40) % 2
    pairs = rng.poisson(np.where(truth[:, None] == truth, 1.0, 30.0))
    found = class_lm.exchange(pairs, 2)
    assert len(set(zip(truth, found, strict=True))) == 2


def test_quality(spark, odd, none, data, docs):
    from quillstone.llm.queries import queries

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = queries()["op5_quality"](spark, data).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.85 * len(out)
    space = quality.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rated = {r.doc_id: r.score for r in quality.rate(docs, space).collect()}
    for i, text in list(texts.items())[:80]:  # votes one by one
        row, key = quality.features(text), quality.text_keys([text])[0]
        v = row * space.idf
        v = (v / np.linalg.norm(v) if v.any() else v) @ space.basis
        near = sorted(((float(b @ v) / max(np.linalg.norm(v), 1e-9), g, w) for b, k, g, w in zip(space.bank, space.keys, space.good, space.weight, strict=True) if k != key), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(s, 1e-3) ** quality.POWER * w, g) for s, g, w in near]
        assert abs(rated[i] - sum(v for v, g in votes if g) / sum(v for v, _ in votes)) < 1e-3
    turned = quality.learn(docs, spark.createDataFrame([(i, q if i != 7 else 1 - q) for i, q in labels.items()] + [(7, 0)] * (7 not in labels), "doc_id long, label int"))
    one = docs.where("doc_id = 7")
    if len(turned.bank) == len(space.bank) and (turned.keys == space.keys).all() and np.isclose(turned.weight, space.weight).all():
        assert quality.rate(one, turned).first().score == quality.rate(one, space).first().score
    assert quality.rate(odd, space).count() == len(ODD) and quality.rate(none, space).count() == 0
    empty = quality.learn(none, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in quality.rate(odd, empty).collect()} == {0.5}
