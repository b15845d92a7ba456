"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words, the stretches that no piece crosses. Per block of documents the distinct words are
gathered; over all blocks each distinct word is then segmented once: its substrings of bounded length
are exploded and equi-joined to the piece table, the pieces found are the edges of the word's lattice,
and Spark's aggregate() folds over them. A unigram model is folded by Viterbi (best score up to each
end). A BPE model's scores are merge ranks, for which the best sum is not the model's own result, so there the fold
applies the best-ranked merge until none is left, which is. Segmentations go back to the blocks, where
documents are put together from them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_width

#: What stands for a space in pieces.
SPACE = "▁"
#: Longest word that is segmented by the lattice (its boundaries are bits of a long); longer ones are merged in Python.
LONGEST = 60
#: Bytes of text a block of documents holds about.
BLOCK_CHARS = 16_000_000
#: Fixed values of the model file: kinds of model and of pieces.
UNIGRAM, BPE = 1, 2
#: Number of the bit of a fold's result that asks for the longer fold; least number of buckets that words are dealt to; input partitions whose words are segmented
#: together; bits of a block's number that tell the runs of one partition apart.
AGAIN, BUCKETS, TOGETHER, RUN_BITS = 62, 512, 32, 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class PieceModel:
    """A model file's pieces. ids: normal piece -> id; scores by id; bytes_: byte -> id where the model falls back to bytes."""

    kind: int
    ids: dict[str, int]
    scores: list[float]
    texts: list[str]
    bytes_: dict[int, int]
    unknown: int
    prefix: bool
    longest: int
    words: re.Pattern  # the stretches that no piece crosses, in a text with spaces marked


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    plan, trained = proto.normalizer_spec, proto.trainer_spec
    if plan.precompiled_charsmap or plan.remove_extra_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only models that leave texts as they are, with spaces before words, are read")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece crosses words")
    return PieceModel(
        trained.model_type, ids, [p.score for p in proto.pieces], [p.piece for p in proto.pieces],
        {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE},
        next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), plan.add_dummy_prefix, max(map(len, ids)), _words(ids),
    )


def _words(pieces: dict[str, int]) -> re.Pattern:
    """No piece goes on before a space. Where no piece holds a line end, or both letters and others, words end there too.
    A letter-like sign that pieces put beside others but never beside letters (a raised digit) counts as another."""
    bare, odd = [p.lstrip(SPACE) for p in pieces], set()
    letter = lambda c: c not in odd and re.match(r"[^\W\d_]", c) is not None
    crossing = lambda: [(a, b) for p in bare for a, b in zip(p[:-1], p[1:], strict=True) if letter(a) != letter(b)]
    odd |= {c for ab in crossing() for c in ab if letter(c) and not c.isalpha()}
    line = "" if any("\n" in p for p in bare) else "\n"
    if crossing() or not line:
        inside = f"{SPACE}*[^{SPACE}{line}]+"
    else:
        more = re.escape("".join(sorted(odd)))
        inside = f"{SPACE}*[^\\W\\d_{more}]+|{SPACE}*(?:[^\\w{SPACE}\\n]|[\\d_{more}])+"
    return re.compile(f"{inside}|{line}|{SPACE}+" if line else f"{inside}|{SPACE}+")


def words_of(text: str | None, model: PieceModel) -> list[str]:
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    return model.words.findall(SPACE + marked if model.prefix else marked)


def chunks_of(text: str, model: PieceModel) -> list[str] | None:
    """What lies between a text's spaces, where each space, and the one that the model puts first, begins a word of its own; else none."""
    if not model.prefix or text.startswith(" ") or "  " in text or SPACE in text:
        return None
    return text.split(" ")


def merge_long(word: str, model: PieceModel) -> list[str]:
    """Symbols of a word of any length under a BPE model: best merges first, the leftmost of equals."""
    import heapq

    symbols: list[str | None] = list(word)
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        whole = symbols[i] + symbols[j]
        at = model.ids.get(whole)
        if at is not None:
            heapq.heappush(heap, (-model.scores[at], i, j, len(whole)))

    for i in range(len(word) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if symbols[i] is None or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != size or after[i] != j:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        after[i] = after[j]
        if after[i] < len(word):
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [s for s in symbols if s is not None]


def best_long(word: str, model: PieceModel) -> list[str]:
    """Symbols of a word of any length under a unigram model: the segmentation of the best score, the first found of equals."""
    low = _lowest(model)
    best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - model.longest), end):
            at = model.ids.get(word[start:end])
            s = model.scores[at] if at is not None else low if end - start == 1 else None
            if s is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    out, end = [], len(word)
    while end:
        out.append(word[back[end] : end])
        end = back[end]
    return out[::-1]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _late(model: PieceModel) -> set[str]:
    """Pieces that some piece of no worse rank begins or ends with: once such a piece is merged, a merge that was passed over may have become possible."""
    out = set()
    for whole, i in model.ids.items():
        for n in range(1, len(whole)):
            for part in (whole[:n], whole[n:]):
                at = model.ids.get(part)
                if at is not None and model.scores[at] <= model.scores[i]:
                    out.add(part)
    return out


def _table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """The pieces of two characters or more, with score, and order: twice the rank (equal scores share one), plus 1 if late."""
    late, long = _late(model), [(model.scores[i], p) for p, i in model.ids.items() if len(p) > 1]
    rank = {s: r for r, s in enumerate(sorted({s for s, _ in long}, reverse=True))}
    return spark.createDataFrame([(p, s, 2 * rank[s] + (p in late)) for s, p in long], "piece string, score double, order long")


def _edges(words: DataFrame, model: PieceModel, keys: list[str], carried: list[Column]) -> DataFrame:
    """keys (word among them), carried, and edges, best first, then leftmost: numbers made of order, start, end and the bit of a late piece; for unigrams
    structs of start, end and score. Rows of equal keys have to lie in one partition already."""
    size, s, e = F.length("word"), F.col("s"), F.col("e")
    starts = words.select(*words.columns, F.explode(F.sequence(F.lit(0), size - 2)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(s + 2, F.least(size, s + model.longest))).alias("e"))
    pieces = spans.withColumn("piece", F.substring("word", s + 1, e - s))
    found = pieces.join(F.broadcast(_table(words.sparkSession, model)), "piece")  # as many rows as the model has pieces
    number = F.shiftleft(F.shiftright("order", 1), 13) + F.shiftleft(s, 7) + F.shiftleft(e, 1) + F.col("order").bitwiseAND(F.lit(1))
    edge = number if model.kind == BPE else F.struct("s", "e", "score")
    return found.groupBy(*keys).agg(*carried, F.sort_array(F.collect_list(edge)).alias("edges"))


def _start(edge: Column) -> Column:
    """An edge's start, with higher bits that shifts of a long do not look at."""
    return F.shiftright(edge, 7).cast("int")


def _end(edge: Column) -> Column:
    return F.shiftright(edge, 1).cast("int")


def _inner(edge: Column) -> Column:
    """The bits between an edge's ends."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, _end(edge)) - F.call_function("shiftleft", F.lit(2).cast("long"), _start(edge))


def _fits(bounds: Column, edge: Column) -> Column:
    """Whether an edge joins two neighbours: its ends are boundaries, and one boundary lies between them."""
    ends = F.call_function("shiftright", bounds, _start(edge)).bitwiseAND(F.call_function("shiftright", bounds, _end(edge)))
    return (ends.bitwiseAND(F.lit(1)) != 0) & (F.bit_count(bounds.bitwiseAND(_inner(edge))) == 1)


def _one_pass(size: Column) -> Column:
    """Boundaries (bits) after each edge, best first, has been merged where it fits; with the bit AGAIN if a late piece made an edge possible that had been passed over."""

    def step(bounds: Column, edge: Column) -> Column:
        merged = bounds.bitwiseAND(F.bitwise_not(_inner(edge)))
        missed = (edge.bitwiseAND(F.lit(1)) != 0) & F.exists("edges", lambda other: (other < edge) & _fits(merged, other))
        return F.when(_fits(bounds, edge), F.when(missed, merged.bitwiseOR(F.lit(1 << AGAIN))).otherwise(merged)).otherwise(bounds)

    return F.aggregate("edges", _bit(size + 1) - F.lit(1), step)


def _merge_fold(size: Column) -> Column:
    """Boundaries (bits) left once the best merge of two neighbours has been made again and again."""

    def step(bounds: Column, _: Column) -> Column:
        best = F.get(F.filter("edges", lambda e: _fits(bounds, e)), F.lit(0))
        return F.coalesce(bounds.bitwiseAND(F.bitwise_not(_inner(best))), bounds)

    return F.aggregate(F.sequence(F.lit(1), size - 1), _bit(size + 1) - F.lit(1), step)


def _viterbi_fold(size: Column, low: float) -> Column:
    """Boundaries (bits) of the best-scored path over `edges` and `singles` (score of each character alone, null where it has no piece)."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("bounds")))

    def step(paths: Column, end: Column) -> Column:
        def via(at: Column, score: Column) -> Column:
            return F.struct((F.get(paths, at)["score"] + score).alias("score"), F.get(paths, at)["bounds"].bitwiseOR(_bit(end)).alias("bounds"))

        longer = F.transform(F.array_sort(F.filter("edges", lambda x: x["e"] == end), lambda a, b: a["s"] - b["s"]), lambda x: via(x["s"], x["score"]))
        options = F.concat(longer, F.array(via(end - 1, F.coalesce(F.get("singles", end - 1), F.lit(low)))))
        worst = F.struct(F.lit(float("-inf")).alias("score"), F.lit(0).cast("long").alias("bounds"))
        return F.concat(paths, F.array(F.aggregate(options, worst, lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))))

    return F.aggregate(F.sequence(F.lit(1), size), start, step, lambda paths: F.element_at(paths, -1)["bounds"])


def segment(words: DataFrame, path: str, keys: list[str] | None = None, carried: list[Column] | None = None) -> DataFrame:
    """keys (word among them), carried, bounds for words of 2 to LONGEST characters: bit i is set where a piece begins at character i, and at the word's end.
    A word that holds no piece of two characters is left out: each of its characters stands alone."""
    model, size, keys, carried = load(path), F.length("word"), keys or ["word"], carried or []
    edged = _edges(words, model, keys, carried)
    others = [c for c in edged.columns if c != "edges"]
    if model.kind == BPE:
        once = edged.withColumn("once", _one_pass(size))
        return once.select(*others, F.when(F.col("once") < (1 << AGAIN), F.col("once")).otherwise(_merge_fold(size)).alias("bounds"))
    singles = F.create_map(*[F.lit(x) for p, i in model.ids.items() if len(p) == 1 for x in (p, model.scores[i])])
    alone = F.transform(F.split("word", ""), lambda c: F.try_element_at(singles, c))
    return edged.withColumn("singles", alone).select(*others, _viterbi_fold(size, _lowest(model)).alias("bounds"))


def _lowest(model: PieceModel) -> float:
    """The score of a character that is no piece."""
    return min(model.scores[i] for i in model.ids.values()) - 10.0


class Segments(dict):
    """word -> ids (little-endian 32-bit), from the boundaries of the words given; others are segmented here, to the same result."""

    def __init__(self, path: str, packed: list[str]):
        super().__init__()
        self.model, self.bounds = load(path), {}
        for some in packed:
            for row in some.split("\n"):
                word, _, bounds = row.rpartition("\t")
                self.bounds[word] = bounds

    def symbol_ids(self, symbol: str) -> list[int]:
        at = self.model.ids.get(symbol)
        if at is not None:
            return [at]
        if self.model.bytes_:
            return [self.model.bytes_[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return [self.model.unknown]

    def __missing__(self, word: str) -> bytes:
        found, ids, known = self.bounds.pop(word, None), [], self.model.ids.get
        if found is not None:
            left, start, end = int(found, 16) >> 1, 0, 1
            while left:
                if left & 1:
                    at = known(word[start:end])
                    if at is None:
                        ids += self.symbol_ids(word[start:end])
                    else:
                        ids.append(at)
                    start = end
                left >>= 1
                end += 1
        else:
            for symbol in [word] if len(word) == 1 else (merge_long if self.model.kind == BPE else best_long)(word, self.model):
                ids += self.symbol_ids(symbol)
        self[word] = coded = array("I", ids).tobytes()
        return coded


class Chunks(dict):
    """What lies between two spaces -> ids of its words, the space before it among them."""

    def __init__(self, known: Segments):
        super().__init__()
        self.known = known

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one word
            coded = self.known[SPACE + chunk]
        else:
            coded = b"".join(map(self.known.__getitem__, self.known.model.words.findall(SPACE + chunk)))
        self[chunk] = coded
        return coded

    def ids(self, text: str) -> bytes:
        """Ids (little-endian 32-bit) of a whole text."""
        chunks = chunks_of(text, self.known.model) if text else []
        if chunks is None:
            return b"".join(map(self.known.__getitem__, words_of(text, self.known.model)))
        return b"".join(map(self.__getitem__, chunks))


class Decoder:
    """Texts from ids; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, path: str):
        m = self.model = load(path)
        byte_of = {i: b for b, i in m.bytes_.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else x.replace(SPACE, " ").encode() for i, x in enumerate(m.texts)]

    def text(self, ids: list[int]) -> str:
        return self._whole(b"".join(map(self.raw.__getitem__, ids)))

    def _whole(self, raw: bytes) -> str:
        out = raw.decode("utf-8", "replace")
        return out[1:] if self.model.prefix and out.startswith(" ") else out

    def texts(self, coded: list[bytes]) -> Iterator[str]:
        """The texts of several documents' ids (little-endian 32-bit)."""
        found = pa.array(self.raw, pa.large_binary()).take(pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
        ends = np.cumsum([0] + [len(x) // 4 for x in coded])
        at, raw = np.frombuffer(found.buffers()[1], np.int64)[ends].tolist(), memoryview(found.buffers()[2] or b"")
        return (self._whole(bytes(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, block_chars: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch with its block: a run of rows of one input partition with about block_chars characters."""
    from pyspark import TaskContext

    first, chars = TaskContext.get().partitionId() << RUN_BITS, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield first + chars // block_chars, piece
            chars += piece.column(text_at).nbytes


def encode(docs: DataFrame, path: str, digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_pieces and ids (array of int) of every row of docs (doc_id, text); with digest, for the ids their crc32 (of
    little-endian 32-bit numbers), and text_crc32 of the text decoded from them.

    A null or empty text has no pieces; repeated rows and null ids are encoded each; characters outside the model become bytes
    or the unknown piece; an empty table gives none. Other columns are not read.
    """
    model = load(path)
    n_buckets = max(BUCKETS, 16 * shuffle_width(docs.sparkSession))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        chunks: set[str] = set()
        now = None

        def out() -> pa.RecordBatch:
            for x in chunks:
                if x.isalpha():  # one word
                    met.add(SPACE + x)
                else:
                    met.update(model.words.findall(SPACE + x))
            buckets: dict[int, list[str]] = {}
            for w in sorted(w for w in met if 1 < len(w) <= LONGEST and "\n" not in w):
                buckets.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % n_buckets, []).append(w)
            rows = ["\n".join(b) for b in buckets.values()]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([now] * len(rows), pa.int64()), "words": pa.array(rows, pa.string())})

        for block, batch in _blocks(batches, 0, block_chars):
            if block != now and (met or chunks):
                yield out()
                met, chunks = set(), set()
            now = block
            for text in batch.column(0).to_pylist():
                parts = chunks_of(text, model) if text else []
                if parts is None:
                    met.update(words_of(text, model))
                else:
                    chunks.update(parts)
        if met or chunks:
            yield out()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for block, batch in _blocks(batches, 1, block_chars):
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            sizes = [-1 if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()), "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())), "texts": pa.array([press.compress(b"".join(t for t in texts if t))], pa.binary()),
                }
            )

    def build(texts: pa.Table, segments: pa.Table) -> pa.Table:
        import zstandard

        known = Chunks(Segments(path, segments["packed"].to_pylist()))
        decoder, doc_ids, counts, ids, back = Decoder(path), [], [], [], []
        for row_ids, sizes, raw in zip(texts["doc_ids"].to_pylist(), texts["sizes"].to_pylist(), texts["texts"].to_pylist(), strict=True):
            raw, at = zstandard.ZstdDecompressor().decompress(raw), 0
            coded = []
            for size in sizes:
                coded.append(known.ids(raw[at : at + max(size, 0)].decode("utf-8", "surrogatepass")))
                at += max(size, 0)
            doc_ids += row_ids
            counts += [len(x) // 4 for x in coded]
            if digest:
                ids += map(zlib.crc32, coded)
                back += [zlib.crc32(text.encode()) for text in decoder.texts(coded)]
            else:
                ids += [np.frombuffer(x, dtype="<i4") for x in coded]
        out = {"doc_id": pa.array(doc_ids, pa.int64()), "n_pieces": pa.array(counts, pa.int64())}
        if digest:
            return pa.table(out | {"ids_crc32": pa.array(ids, pa.int64()), "text_crc32": pa.array(back, pa.int64())})
        return pa.table(out | {"ids": pa.array(ids, pa.list_(pa.int32()))})

    # words travel by bucket and stay there: what follows is grouped within buckets
    dealt = docs.select("text").mapInArrow(words, "bucket int, block long, words string").repartition(n_buckets // 4, "bucket")
    pairs = dealt.select("bucket", "block", F.explode(F.split("words", "\n")).alias("word"))
    # a word is segmented once for TOGETHER input partitions; `in_` has a bit for each that holds it
    part, run = F.shiftright("block", RUN_BITS), F.col("block").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    near = F.shiftleft(F.floor(part / TOGETHER).cast("long"), RUN_BITS) + run
    distinct = pairs.groupBy("bucket", "word", near.alias("near")).agg(F.bit_or(_bit(part % TOGETHER)).alias("in_"))
    found = segment(distinct, path, ["bucket", "word", "near"], [F.first("in_").alias("in_")])
    row = F.concat("word", F.lit("\t"), F.hex("bounds"))
    holds = F.filter(F.sequence(F.lit(0), F.lit(TOGETHER - 1)), lambda i: F.col("in_").bitwiseAND(_bit(i)) != 0)
    each = found.select("bucket", "near", F.explode(holds).alias("i"), row.alias("row"))
    at = F.shiftleft(F.shiftright("near", RUN_BITS) * TOGETHER + F.col("i"), RUN_BITS) + F.col("near").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    segments = each.groupBy("bucket", at.alias("block")).agg(F.array_join(F.collect_list("row"), "\n").alias("packed"))
    texts = docs.select("doc_id", "text").mapInArrow(packed, "block long, doc_ids array<long>, sizes array<long>, texts binary")
    schema = "doc_id long, n_pieces long, " + ("ids_crc32 long, text_crc32 long" if digest else "ids array<int>")
    return texts.groupBy("block").cogroup(segments.select("block", "packed").groupBy("block")).applyInArrow(build, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids array of int); null ids give a null text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            texts = [None if x is None else decoder.text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: how many, checksum of their ids, and checksum of the text decoded from them."""
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
