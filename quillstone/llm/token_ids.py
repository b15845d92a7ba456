"""Token ids of documents in Simple-8b files.

Texts are brought into ascending doc_id order by range partitioning, encoded where they lie, and each
partition's ids are written as segments: one Parquet row with the documents' ids and lengths, the coded
words, the first word of each block and the escapes. Parquet carries the segments so that Spark's
committer keeps the files whole when tasks are retried, in any store that Spark can write.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import simple8b
from .common import documents, shared_dir

#: Ids a segment holds at least, unless the partition ends; words that a worker remembers; characters whose words are looked up at once.
SEGMENT, REMEMBERED, AT_ONCE = 1 << 20, 400_000, 1 << 22
SEGMENTS = "part int, segment int, doc_ids array<long>, lengths array<long>, words binary, offsets array<int>, escapes array<long>"

#: ASCII signs that may be parted from a letter or digit before them: no token holds both, and none is an apostrophe. The letter has to stay one
#: under the tokenizer's normalizer: where that adds a combining mark, the mark goes with the sign.
SIGNS = ".,;:!?*$%&#|<>\"()[]{}-_=+/\\@^~`"
#: Bytes of a text with line ends as spaces, and with A-Z in lower case besides; the lead byte of the first combining mark (U+0300), before which no letter changes with its case.
SPACED = bytes.maketrans(b"\n", b" ")
FOLDED = bytes.maketrans(b"\nABCDEFGHIJKLMNOPQRSTUVWXYZ", b" abcdefghijklmnopqrstuvwxyz")
MARKS = 0xCC


class WordEncoder:
    """A tokenizer that lets no token cross white space, or a change from letters to signs, with the words it has met.

    `known` has the ids (little-endian 32-bit) of whole words and of their parts before and after signs, by UTF-8 bytes. When it is full it becomes
    the older generation, from which words still in use are taken over.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.cuttable: dict[str, bool] = {}
        self.is_sign, self.is_letter = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.is_sign[list(SIGNS.encode())] = True
        self.is_letter[[c for c in range(128) if self.may_end(chr(c))]] = True
        # whether words of a-z go to the model as they are
        letters, plan, parts = "abcdefghijklmnopqrstuvwxyz", self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = (plan.normalize_str(letters) if plan else letters) == letters and parts is not None and parts.pre_tokenize_str(letters) == [(letters, (0, 26))]

    def may_end(self, letter: str) -> bool:
        """Whether signs may be parted from this character."""
        ok = self.cuttable.get(letter)
        if ok is None:
            plan = self.tokenizer.normalizer
            form = letter + (plan.normalize_str(letter) if plan else letter)
            ok = self.cuttable[letter] = len(form) > 1 and all(c.isalpha() or c.isdecimal() for c in form)
        return ok

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts without the spaces, signs after an ASCII letter or digit at a word's end as a word of their own; and how many words precede the end of each text."""
        raw = [t.encode() for t in texts]
        joined = b" ".join([b"", *raw, b""])
        apart = b"<|" not in joined  # no special token, which is met as it is written
        joined = joined.translate(FOLDED if apart and np.frombuffer(joined, np.uint8).max() < MARKS else SPACED)
        code = np.frombuffer(joined, np.uint8)
        space = code == 32
        ends = space
        if apart:
            sign = self.is_sign[code]
            turns = np.flatnonzero(sign[1:] != sign[:-1]) + 1  # the text begins and ends with a space, so these are starts and stops in turn
            starts, stops = turns[::2], turns[1::2]
            ends = space.copy()
            ends[starts[self.is_letter[code[starts - 1]] & space[stops]]] = True
        ends = np.flatnonzero(ends)
        spaces = space[ends]
        offsets = np.concatenate([[0], ends - np.cumsum(spaces) + spaces]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, b" "))])
        return words, np.searchsorted(ends, np.cumsum([len(t) + 1 for t in raw])) + 1

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is new in all of them is learnt at once."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {b"": b""}
        words, ends = self.words(texts)
        coded = words.dictionary_encode()
        at, raw = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist(), bytes(coded.dictionary.buffers()[2] or b"")
        distinct = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.learn([w for w in distinct if w not in self.known])
        each = [self.known[w] for w in distinct]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        found = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(each))]).take(coded.indices)
        at = np.frombuffer(found.buffers()[1], np.int64)[np.concatenate([[0], ends])].tolist()
        ids = memoryview(found.buffers()[2] or b"")
        return [bytes(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def halves(self, word: str) -> tuple[bytes, bytes]:
        """A word before and after the signs at its end (ASCII in lower case)."""
        part, tail = word.rstrip(SIGNS), ""
        if "<|" in word:
            return word.encode(), b""
        if part and part != word and self.may_end(part[-1]):
            tail = word[len(part) :]
        else:
            part = word
        return (part.lower() if part.isascii() else part).encode(), tail.encode()

    def learn(self, new: list[bytes]) -> None:
        known, older, todo, wanted, tokenize = self.known, self.older, [], set(), self.tokenizer.model.tokenize
        for word in new:
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif self.bare and word.isalpha() and word.islower():
                known[word] = array("I", [t.id for t in tokenize(word.decode())]).tobytes()
            else:
                part, tail = self.halves(word.decode())
                todo.append((word, part, tail))
                wanted.update((part, tail))
        rest = {x: x.decode() for x in wanted.difference(known)}
        plain = [x for x, text in rest.items() if text.isalpha()]
        if plain:  # one word of letters each, so each ends with one token that ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(map(rest.__getitem__, plain))], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), 0
                for x, end in zip(plain, ends.tolist(), strict=True):
                    known[x] = raw[at:end]
                    at = end
        for x, text in rest.items():
            if x not in known:
                known[x] = self.ids(text)
        for word, part, tail in todo:
            known[word] = known[part] + known[tail]


_encoders: dict[str, WordEncoder] = {}


def encode_texts(texts: list[str], path: str, by_word: bool = True) -> list[bytes]:
    """Ids of texts; by_word: through the words that the worker remembers, which must suit the tokenizer."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path].texts(texts) if by_word else list(map(_encoders[path].ids, texts))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """Rows (doc_id, text) in runs of about AT_ONCE characters."""
    run, chars = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            run.append((doc_id, text or ""))
            chars += len(run[-1][1])
            if chars > AT_ONCE:
                yield run
                run, chars = [], 0
    if run:
        yield run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, by_word: bool = True) -> None:
    """Encode every text of docs (doc_id, text) and write segments to path, ascending by doc_id.

    A null text counts as empty; each document ends with end_id, so an empty one has a single id. A null
    doc_id comes first; repeated ids stay beside each other, by text hash. Other columns are not read.
    An empty table writes files without segments.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        ids, held, lengths, pieces = [], 0, [], []

        def flush() -> pa.RecordBatch:
            words, offsets, escapes = simple8b.encode(np.frombuffer(b"".join(pieces), dtype="<u4"))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "segment": pa.array([at], pa.int32()),
                    "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()), "offsets": pa.array([offsets], pa.list_(pa.int32())),
                    "escapes": pa.array([escapes.astype(np.int64)], pa.list_(pa.int64())),
                }
            )

        for run in _together(batches):
            for (doc_id, _), coded in zip(run, encode_texts([t for _, t in run], tokenizer, by_word), strict=True):
                coded += end
                ids.append(doc_id)
                lengths.append(len(coded) // 4)
                pieces.append(coded)
                held += lengths[-1]
                if held >= SEGMENT:
                    yield flush()
                    ids, held, lengths, pieces, at = [], 0, [], [], at + 1
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """part, segment, at (position in the segment), doc_id, ids_at (ids before it in the segment), n_tokens, and ids (binary, little-endian 32-bit), or with digest their ids_crc32 alone."""

    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                ids = simple8b.decode(np.frombuffer(row["words"], dtype="<u8"), np.array(row["offsets"], dtype=np.int64), np.array(row["escapes"], dtype=np.int64).astype(np.uint64), int(lengths.sum()))
                raw = ids.astype("<u4").tobytes()
                starts = np.cumsum(lengths) - lengths
                n = len(lengths)
                each = [raw[4 * s : 4 * (s + k)] for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * n, pa.int32()), "segment": pa.array([row["segment"]] * n, pa.int32()), "at": pa.array(range(n), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "ids_at": pa.array(starts), "n_tokens": pa.array(lengths),
                        last: pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary()),
                    }
                )

    return spark.read.schema(SEGMENTS).parquet(path).mapInArrow(unpack, f"part int, segment int, at int, doc_id long, ids_at long, n_tokens long, {last} {kind}")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment and the number of ids before the segment in all files, from the segments' lengths alone."""
    sizes = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()  # as many as the writer had tasks
    before, run = [], 0
    for r in sorted(parts):
        before.append((r.part, run))
        run += r.n
    table = F.broadcast(spark.createDataFrame(before, "part int, first long"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(table, "part").select("part", "segment", (F.col("first") + F.col("inside")).alias("segment_start"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, from files written and read back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = read_ids(spark, path, digest=True)
    starts = segment_starts(spark, path)
    return rows.select("part", "segment", "doc_id", "ids_at", "n_tokens", "ids_crc32").join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("segment_start") + F.col("ids_at")).alias("start"), "n_tokens", "ids_crc32"
    )
