"""Language model scores from Brown class-based n-grams.

Counts of all words are gathered from all training documents. The most frequent words (the lexicon, of bounded size)
have ids. Exchange clustering assigns all of them to classes that make the class bigrams most likely: the most
frequent words one by one on the driver, then all words in rounds, each word judged where its neighbours' counts lie, against the
class bigrams as they were before the round. Words met once and those outside the lexicon form one open class. A text's probability is the
product of class transitions, from the last word of the lexicon, and of word emissions from classes, both smoothed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, shuffle_width

#: Size of the lexicon and longest word in it (its broadcast is below LEXICON * (LONGEST + 16) bytes), words clustered first, classes, sweeps over those, rounds over all.
LEXICON, LONGEST, CORE, CLASSES, SWEEPS, ROUNDS = 262_144, 64, 512, 40, 10, 4
#: Pairs of neighbours that are summed at once, words judged at once.
PAIRS, JUDGED = 1 << 22, 1024
#: Weight of the class frequencies behind the transitions; words after which a task hands on its counts.
PRIOR, HELD = 20.0, 400_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at space and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts; the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What the executors need to score. Ids are positions in the lexicon by falling count; the end of a text and the open class follow the word classes."""

    ids: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray  # of each id
    n_classes: int  # of words of the lexicon
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log10 of class after state
    emits: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of word in its class
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the word alone

    @property
    def end(self) -> int:
        return self.n_classes

    @property
    def open(self) -> int:
        return self.n_classes + 1

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Ids, -1 for words outside the lexicon."""
        return np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def path(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, class) of each token, the end included. The state is the class of the last word of the lexicon, at first the end."""
        klass = np.append(np.where(ids >= 0, self.classes[ids] if len(self.classes) else self.open, self.open), self.end)
        before = np.concatenate([[self.end], klass[:-1]])
        at = np.where(before != self.open, np.arange(len(before)), 0)
        return before[np.maximum.accumulate(at)], klass


def _sums(texts: DataFrame, model, cells: int, codes) -> DataFrame:
    """code, n: how often each code below `cells` comes up; codes(model, ids) gives a text's codes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = model.value, np.zeros(cells, dtype=np.int64)
        for batch in batches:
            held, n = [], 0
            for text in batch.column(0).to_pylist():
                held.append(codes(m, m.encode(words_of(text))))
                n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
            if n:
                total += np.bincount(np.concatenate(held), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": at, "n": total[at]})

    return texts.select("text").mapInArrow(add, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _table(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums as an array; at most as many rows as it has cells."""
    got, out = sums.toArrow(), np.zeros(int(np.prod(shape)), dtype=np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(shape)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word: words move, one by one, to the class that makes the bigrams `pairs` most likely, until none moves."""
    n, pairs = len(pairs), pairs.astype(np.float64)
    classes = max(1, min(classes, n))
    of, each = np.arange(n) % classes, np.arange(classes)
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    m = one.T @ pairs @ one  # bigrams of classes
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            at, own = of[w], pairs[w, w]
            one[w, at] = 0
            after, before = pairs[w] @ one, pairs[:, w] @ one
            m[at] -= after
            m[:, at] -= before
            m[at, at] -= own
            d = np.diagonal(m)
            gain = (_g(m + after) - _g(m)).sum(axis=1) + (_g(m + before[:, None]) - _g(m)).sum(axis=0)
            gain += _g(d + after + before + own) + _g(d) - _g(d + after) - _g(d + before)
            left = np.tile((m.sum(axis=1) + before)[:, None], classes)
            right = np.tile((m.sum(axis=0) + after)[:, None], classes)
            left[each, each] += after.sum() + own
            right[each, each] += before.sum() + own
            gain -= _g(left).sum(axis=0) + _g(right).sum(axis=0)
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[at] + 1e-6 else at
            moved += best != at
            of[w] = best
            one[w, best] = 1
            m[best] += after
            m[:, best] += before
            m[best, best] += own
        if not moved:
            break
    return of


def _pressed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").tobytes())


def _loosened(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<i4").astype(np.int64)


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their times."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def neighbours(texts: DataFrame, model, buckets: int) -> DataFrame:
    """bucket, side, w, o, n: how often each word w of the lexicon stands before (side 0) or after (side 1) each other one, o, as packed numbers, all
    of a word in one bucket. Words outside the lexicon are passed over. The words' ids are steps from one row to the next."""
    schema = "bucket int, side int, w binary, o binary, n binary"

    def packed(bucket: list[int], side: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [[_pressed(x) for x in (np.diff(code >> 32, prepend=0), code & 0xFFFFFFFF, times)] for code, times in parts]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "side": pa.array(side, pa.int32())} | {c: pa.array([x[i] for x in columns], pa.binary()) for i, c in enumerate("won")})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, n = model.value, [], 0

        def out() -> pa.RecordBatch:
            codes, times = _summed(np.concatenate(held), np.ones(n, dtype=np.int64))
            bucket, side, parts = [], [], []
            for which in (0, 1):
                if which:
                    turned = (codes & 0xFFFFFFFF) << 32 | codes >> 32
                    order = np.argsort(turned, kind="stable")
                    codes, times = turned[order], times[order]
                of = (codes >> 32) % buckets
                order = np.argsort(of, kind="stable")
                of = of[order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
                    bucket.append(int(of[i]))
                    side.append(which)
                    parts.append((codes[order[i:j]], times[order[i:j]]))
            return packed(bucket, side, parts)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = m.encode(words_of(text))
                ids = ids[ids >= 0]
                if len(ids) > 1:
                    held.append(ids[:-1] << 32 | ids[1:])
                    n += len(ids) - 1
                if n > PAIRS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, times, held = None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["bucket"], row["side"])
                if now is not None and at != now:
                    yield packed([now[0]], [now[1]], [_summed(codes, times)])
                    codes, times, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                now = at
                codes = np.concatenate([codes, np.cumsum(_loosened(row["w"])) << 32 | _loosened(row["o"])])
                times = np.concatenate([times, _loosened(row["n"])])
                if len(codes) > held + PAIRS:
                    codes, times = _summed(codes, times)
                    held = len(codes)
        if now is not None:
            yield packed([now[0]], [now[1]], [_summed(codes, times)])

    dealt = texts.select("text").mapInArrow(gather, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket", "side")
    return cut(dealt.mapInArrow(merge, schema))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_loosened(row["w"])), _loosened(row["o"]), _loosened(row["n"])


def _pair_sums(beside: DataFrame, cells: int, codes) -> DataFrame:
    """code, n: sums over pairs; codes(w, o) gives the code below `cells` of each pair, -1 for none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                w, o, n = _unpacked(row)
                at = codes(w, o)
                total += np.bincount(at[at >= 0], weights=n[at >= 0], minlength=cells).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": at, "n": total[at]})

    return beside.where("side = 0").mapInArrow(add, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def gains(m: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """(words, classes): what the likelihood gains from each word, taken out of its own class (-1: of none), in each class. m: bigrams of classes; after, before:
    how often each class follows and precedes the word, without itself; twice: how often the word follows itself."""
    m, each = m.astype(np.float64), np.arange(len(own))
    has = np.flatnonzero(own >= 0)
    at, both = own[has], twice[:, None]
    d = np.repeat(np.diagonal(m)[None], len(own), axis=0)
    d[has, at] -= after[has, at] + before[has, at] + twice[has]
    out = _g(d + after + before + both) + _g(d) - _g(d + after) - _g(d + before)
    for table, here, there in ((m, after, before), (m.T, before, after)):  # rows of classes and what follows them, then columns and what precedes them
        i, j = np.nonzero(here)  # nothing changes elsewhere
        rest, n, mine = table.T[j], here[i, j], own[i]
        in_class, same = np.flatnonzero(mine >= 0), np.flatnonzero(mine == j)
        rest[in_class, mine[in_class]] -= n[in_class]
        rest[same] -= there[i[same]]
        rest[same, j[same]] -= twice[i[same]]
        change = _g(rest + n[:, None]) - _g(rest)
        some = np.flatnonzero(np.bincount(i, minlength=len(own)))
        if len(some):
            out[some] += np.add.reduceat(change, np.searchsorted(i, some), axis=0)
        total = np.repeat(table.sum(axis=1)[None], len(own), axis=0) - np.where(own >= 0, 1.0, 0.0)[:, None] * there
        total[has, at] -= here[has].sum(axis=1) + twice[has]
        total += there
        out -= _g(total + here.sum(axis=1, keepdims=True) + both) - _g(total)
    return out


def _moved(beside: DataFrame, classes: np.ndarray, m: np.ndarray, turn: int) -> DataFrame:
    """w, class of the words that move: those without a class, and in each turn every other one of the rest, if that makes the bigrams likelier."""
    sent, k = beside.sparkSession.sparkContext.broadcast((classes, m)), len(m)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = sent.value
        sides: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sides.setdefault(row["bucket"], {})[row["side"]] = _unpacked(row)
        for parts in sides.values():
            words = np.unique(np.concatenate([p[0] for p in parts.values()]))
            words = words[(of[words] < 0) | (words % 2 == turn % 2)]
            sums, twice = {}, np.zeros(len(words))
            for side in (0, 1):
                w, o, n = parts.get(side, (np.zeros(0, np.int64),) * 3)
                at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
                ok = (words[at] == w) if len(words) else np.zeros(len(w), bool)
                if side == 0:
                    twice += np.bincount(at[ok & (w == o)], weights=n[ok & (w == o)], minlength=len(words))[: len(words)]
                ok &= (w != o) & (of[o] >= 0)
                sums[side] = np.bincount(at[ok] * k + of[o[ok]], weights=n[ok], minlength=len(words) * k).reshape(-1, k)
            for i in range(0, len(words), JUDGED):
                some = slice(i, i + JUDGED)
                own = of[words[some]]
                gain = gains(table, own, sums[0][some], sums[1][some], twice[some])
                best, each = gain.argmax(axis=1), np.arange(len(own))
                go = (own < 0) | (gain[each, best] > gain[each, np.maximum(own, 0)] + 1e-6)
                yield pa.RecordBatch.from_pydict({"w": words[some][go], "class": best[go]})

    return beside.mapInArrow(judge, "w long, class long")


def cluster(beside: DataFrame, words: int, core: int = CORE, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each of `words` words, from their neighbours. Words that have none are dealt out."""
    core = min(core, words)
    if not core:
        return np.zeros(0, np.int64)
    inside = lambda w, o: np.where((w < core) & (o < core), w * core + o, -1)
    of_core = exchange(_table(_pair_sums(beside, core * core, inside), (core, core)), classes)
    k = int(of_core.max()) + 1
    now = np.concatenate([of_core, np.full(words - core, -1, dtype=np.int64)])
    best, most = now, -np.inf
    for turn in range(rounds + 1):
        placed = now
        pairs = lambda w, o, of=placed: np.where((of[w] >= 0) & (of[o] >= 0), of[w] * k + of[o], -1)
        m = _table(_pair_sums(beside, k * k, pairs), (k, k)).astype(float)
        likely = (_g(m).sum() - _g(m.sum(axis=0)).sum() - _g(m.sum(axis=1)).sum()) if turn else -np.inf
        if likely > most:
            best, most = now, likely
        elif turn:
            break
        if turn < rounds:
            got = _moved(beside, placed, m, turn).toArrow()  # at most as many rows as the lexicon has words
            now = placed.copy()
            now[got["w"].to_numpy()] = got["class"].to_numpy()
            if not turn:
                best = now
            if not got.num_rows:
                break
    return np.where(best >= 0, best, np.arange(words) % k)


def fit(train: DataFrame, lexicon: int = LEXICON, core: int = CORE, classes: int = CLASSES) -> tuple[Model, DataFrame, dict]:
    """(model, counts of all words, totals) from the texts of train."""
    spark = train.sparkSession
    counts = cut(word_counts(train))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count("*").alias("V")).first().asDict()
    usable = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST) & (F.col("c") > 1))  # words met once stand in for those not met
    least, n = None, 0
    for r in usable.groupBy("c").count().sort(F.desc("c")).toLocalIterator():
        if n + r["count"] > lexicon:
            break
        least, n = r.c, n + r["count"]
    top = usable.where(F.col("c") >= least).toPandas() if least is not None else None
    if top is not None:
        top = top.sort_values(["c", "word"], ascending=[False, True], kind="stable")
    ids = {bytes(w): i for i, w in enumerate(top["word"])} if top is not None else {}
    c = top["c"].to_numpy(dtype=np.int64) if top is not None else np.zeros(0, np.int64)

    sent = spark.sparkContext.broadcast(Model(ids, c, np.zeros(len(c), np.int64), 1))
    of_all = cluster(neighbours(train, sent, 4 * shuffle_width(spark)), len(ids), core, classes)
    model = Model(ids, c, of_all, int(of_all.max(initial=0)) + 1)
    sent_classes = spark.sparkContext.broadcast(model)
    k = model.n_classes + 2

    def move_codes(m: Model, x: np.ndarray) -> np.ndarray:
        state, klass = m.path(x)
        return state * k + klass

    seen = _table(_sums(train, sent_classes, k * k, move_codes), (k, k)).astype(float)
    unigram = (seen.sum(axis=0) + 1) / (seen.sum() + k)
    moves = np.log10((seen + PRIOR * unigram) / (seen.sum(axis=1, keepdims=True) + PRIOR))
    in_class = np.bincount(of_all, weights=c, minlength=model.n_classes)
    emits = np.log10(np.maximum(c, 1) / np.maximum(in_class[of_all], 1)) if len(c) else np.zeros(0)
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    totals |= {"open_N": totals["N"] - int(c.sum()) - ends, "open_V": totals["V"] - len(ids) - (ends > 0), "ends": ends, "least": least}
    model.moves, model.emits = moves, emits
    model.base = np.log10((c + 1) / (totals["N"] + totals["V"] + 1))
    return model, counts, totals


def score(docs: DataFrame, train: DataFrame, held: Column, **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text); learned from train (text).

    A null or empty text is its end alone; repeated rows are scored each; a null doc_id stays null; without training texts all words are
    unknown and both scores fall back to the smoothing; an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    model, counts, totals = fit(train, **sizes)
    sent = spark.sparkContext.broadcast(model)
    per_token = float(np.log10(totals["N"] + totals["V"] + 1))
    end_base = float(np.log10(totals["ends"] + 1)) - per_token
    open_all = float(np.log10(totals["open_N"] + totals["open_V"] + 1))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, open array<binary>, times array<long>"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            cols: dict = {c: [] for c in ("n_tokens", "n_known", "base", "score", "open", "times")}
            for text in batch.column(3).to_pylist():
                words = words_of(text)
                ids = m.encode(words)
                inside = ids[ids >= 0]
                state, klass = m.path(ids)
                other = Counter([words[i] for i in np.flatnonzero(ids < 0).tolist()])
                row = (
                    len(words) + 1, len(inside) + (totals["ends"] > 0), float(m.base[inside].sum()) + end_base,
                    float(m.moves[state, klass].sum() + m.emits[inside].sum()), list(other), list(other.values()),
                )
                for c, v in zip(cols, row, strict=True):
                    cols[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    first = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text").mapInArrow(rate, schema))
    open_words = first.select("row", F.explode(F.arrays_zip("open", "times")).alias("x")).select("row", F.col("x.open").alias("word"), F.col("x.times").alias("times"))
    rare = counts if totals["least"] is None else counts.where((F.col("c") < totals["least"]) | (F.octet_length("word") > LONGEST))
    known = F.coalesce("c", F.lit(0))
    log = F.log10(known + 1) * F.col("times")
    sums = open_words.join(rare.where(F.octet_length("word") > 0), "word", "left").groupBy("row").agg(
        F.sum(log - F.lit(per_token) * F.col("times")).alias("open_base"), F.sum(log - F.lit(open_all) * F.col("times")).alias("open_score"),
        F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("open_known"),
    )
    zero = F.lit(0.0)
    return first.drop("open", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("open_known", F.lit(0))).alias("n_known"), F.lit(totals["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("open_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("open_score", zero)).alias("score"),
    )


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class model scores of all documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs, held = documents(spark, sf_dir), held_out(7, 2)
    return score(docs, docs.where(~held), held)
