"""Token-id output: blocks of ids under an adaptive context-mixing range coder.

A block is coded alone: its model starts afresh, and checksums cover its bytes and its ids. Its ids are dealt
into lanes, stretches of the block that are coded side by side so that every step is a few array
operations; all lanes share one model. Each step mixes three distributions over the vocabulary: that of order 0
(counts of the ids that the others did not foresee), and those of order 1 and order 2 (the two successors of the last id, or
of the last two, that were met most, with their counts). The weights of the mixture are learnt for every
combination of the successors' counts. As the mixture is linear, so are its cumulative sums, and an id is coded by one
interval of it. The coder is a carryless range coder of 64 bits that puts out 32 bits at once.

File format: Parquet, so that any store and Spark's commit protocol serve. `blocks` has rows in ascending order of
(file_no, block_no) that hold documents in ascending order of doc_id; `block` is the coded block. `manifest` has
one row per file: its blocks, documents and ids, and `start`, the ids of all files before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import doc_texts, text_runs, word_cache

MAGIC = b"TCB2"
FRAME = struct.Struct("<4sI")  # magic, crc32 of all bytes that follow
HEAD = struct.Struct("<IIIIQII")  # documents, ids, lanes, vocabulary, ids before it in its file, crc32 of the ids, size of the document table
BLOCK_IDS, MOST_LANES, LEAST_STEPS = 1 << 21, 8192, 256
NO_ID = -(2**63)  # stands for a null doc_id
ORDER0_BITS, MIX_BITS, HASH_BITS, ID_BITS = 19, 9, 16, 18
TOTAL = np.uint64(ORDER0_BITS + MIX_BITS)
BOTTOM, HALF, LOW = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
PAIRS = [(i, k) for i in range(4) for k in range(4) if i != k]
BEHIND = np.int32(1 << ID_BITS)  # above all ids
EARLY = (1, 2, 4, 8, 16)  # steps after which the model is rebuilt, besides every 32nd
BLOCKS = "file_no int, block_no int, n_docs long, n_tokens long, block binary"
DOCS = "doc_id long, file_no int, _in_file long, n_tokens long, ids_crc32 long"


def _transitions() -> np.ndarray:
    """New counts of a context's two successors (two bits each, and whether they change places) by
    old counts and by which of them came: bit 0 the first, bit 1 the second. An unforeseen id replaces the second."""
    out = np.zeros((16, 4), np.int32)
    for first in range(4):
        for second in range(4):
            for came in range(4):
                a, b = (min(first + 1, 3), second) if came & 1 else (first, min(second + 1, 3)) if came else (max(first - 1, 0), 1)
                out[first | second << 2, came] = max(a, b) | min(a, b) << 2 | (b > a) << 4
    return out.ravel()


TRANSITIONS = _transitions()


def _credits() -> np.ndarray:
    """Which part of the mixture gets the credit for an id, by the bits of those that foresaw it: order 2 before order 1 before order 0."""
    out = np.zeros((16, 5), np.int64)
    for bits in range(16):
        out[bits, 1 if bits & 4 else 3 if bits & 8 else 0 if bits & 1 else 2 if bits & 2 else 4] = 1
    return out


CREDITS = _credits()


class Mixer:
    """The model that both directions share; it sees the same ids at the same steps in both.

    A context is one long: the counts of its two successors, the first and the second. Parts of the mixture
    are the first successors under order 1 and 2, the second ones, and order 0.
    """

    def __init__(self, vocab: int, lanes: int, decode: bool):
        if not 0 < vocab <= 1 << ID_BITS:
            raise ValueError(f"ids must be under {1 << ID_BITS}")
        self.vocab, self.decode = vocab, decode
        self.order1, self.order2 = np.zeros(vocab, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        self.entries, self.ids, self.weight = np.zeros((2, lanes), np.int64), np.zeros((4, lanes), np.int32), np.zeros((5, lanes), np.int32)
        self.counts = np.zeros(vocab, np.int64)
        self.credit = np.tile(np.array([[1], [1], [1], [1], [16]], np.int64), (1, 256))
        self.step, self.unforeseen, self.foreseen = 0, [], []
        self.rebuild()

    def rebuild(self) -> None:
        total, room = self.counts.sum(), (1 << ORDER0_BITS) - self.vocab
        self.size0 = (1 + (self.counts * room // total if total else np.full(self.vocab, room // self.vocab))).astype(np.int32)
        self.cum0 = np.concatenate(([0], np.cumsum(self.size0))).astype(np.int32)
        if self.decode:
            self.inverse = np.repeat(np.arange(self.vocab, dtype=np.int32), self.size0)
        weight = 1 + self.credit * ((1 << MIX_BITS) - 5) // self.credit.sum(0)
        weight[4] += (1 << MIX_BITS) - weight.sum(0)
        self.weights = np.concatenate((weight[:4] << ORDER0_BITS, weight[4:])).astype(np.int32)

    def predict(self, last1: np.ndarray, last2: np.ndarray) -> None:
        self.last1 = last1
        self.slot = ((last1 * 40503 ^ last2 * 60493) * 2654435761 >> 13) & ((1 << HASH_BITS) - 1)
        self.order1.take(last1, out=self.entries[0], mode="clip")
        self.order2.take(self.slot, out=self.entries[1], mode="clip")
        halves = self.entries.view(np.int32).reshape(2, -1, 2)
        self.sure = halves[:, :, 0] & 15
        np.right_shift(halves[:, :, 0], 4, out=self.ids[:2])
        self.ids[2:] = halves[:, :, 1]
        self.context = (self.sure[1] << 4) | self.sure[0]
        self.weights.take(self.context, axis=1, out=self.weight, mode="clip")

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixture's cumulative sum stands before each id, and the id's share."""
        ids, weight = self.ids, self.weight
        self.hit = ids == x
        size = weight[4] * self.size0.take(x, mode="clip") + (weight[:4] * self.hit).sum(0, dtype=np.int32)
        start = weight[4] * self.cum0.take(x, mode="clip") + (weight[:4] * (ids < x)).sum(0, dtype=np.int32)
        return start.view(np.uint32), size.view(np.uint32)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the values lie.

        Successors whose intervals end at or before the value are behind it; without their weights the value is one
        of order 0 alone, unless it lies in the interval of the least successor that is not behind it.
        """
        ids, weight = self.ids, self.weight
        ends = self.cum0[1:].take(ids, mode="clip")
        ends *= weight[4]
        ends += weight[:4]
        for i, k in PAIRS:
            ends[i] += weight[k] * (ids[i] >= ids[k])
        behind = ends <= value
        inner = value - (weight[:4] * behind).sum(0, dtype=np.int32)
        x = self.inverse.take((inner / weight[4]).astype(np.int64), mode="clip")  # exact: under 2**28 by under 2**9
        return np.minimum(x, (ids + behind * BEHIND).min(0))

    def learn(self, x: np.ndarray) -> None:
        hit = self.hit.view(np.uint8)
        came = hit[:2] + (hit[2:] << 1)
        now = TRANSITIONS.take(self.sure * 4 + came, mode="clip")
        first, second = self.ids[:2], np.where(hit[:2], self.ids[2:], x)
        lead = np.where(now > 15, second, first)
        new = np.empty((2, len(x), 2), np.int32)
        new[:, :, 0] = (lead << 4) | (now & 15)
        new[:, :, 1] = first + second - lead
        new = new.view(np.int64)[:, :, 0]
        self.order1[self.last1], self.order2[self.slot] = new[0], new[1]
        bits = came[0] + (came[1] << 2)
        self.unforeseen.append(x[bits == 0])
        self.foreseen.append(self.context * 16 + bits)
        self.step += 1
        if self.step % 32 == 0 or self.step in EARLY:
            self.counts += np.bincount(np.concatenate(self.unforeseen), minlength=self.vocab) * 32
            self.credit += (np.bincount(np.concatenate(self.foreseen), minlength=4096).reshape(256, 16) @ CREDITS).T
            self.unforeseen, self.foreseen = [], []
            self.rebuild()


def _lanes(n: int) -> int:
    return min(MOST_LANES, max(1, n // LEAST_STEPS))


def _settle(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range has become short, and the 32 bits that each of them puts out or takes in.

    A short range that lies across a change of those bits is cut at it, so no carry can come.
    """
    who = np.flatnonzero(rng < BOTTOM)
    a, b = low[who], rng[who]
    b = np.where((a ^ (a + b - np.uint64(1))) >> HALF, -a & LOW, b)
    low[who], rng[who] = a << HALF, b << HALF
    return who, a >> HALF


def encode_ids(ids: np.ndarray, vocab: int) -> bytes:
    """Codes ids, all under vocab; lane lengths come first, then each lane's 32-bit words."""
    n = len(ids)
    if not n:
        return b""
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    mixer = Mixer(vocab, lanes, False)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    last1 = last2 = np.zeros(lanes, np.int64)
    words, of = [], []
    for x in grid:
        mixer.predict(last1, last2)
        start, size = mixer.interval(x)
        r = rng >> TOTAL
        low += r * start
        rng = r * size
        who, out = _settle(low, rng)
        words.append(out.astype(np.uint32))
        of.append(who.astype(np.uint16))
        mixer.learn(x)
        last1, last2 = x.astype(np.int64), last1
    words.append(((low + rng - np.uint64(1)) >> HALF).astype(np.uint32))
    of.append(np.arange(lanes, dtype=np.uint16))
    words, of = np.concatenate(words), np.concatenate(of)
    lengths = zlib.compress(np.bincount(of, minlength=lanes).astype("<u4").tobytes())
    return struct.pack("<I", len(lengths)) + lengths + words[np.argsort(of, kind="stable")].astype("<u4").tobytes()


def decode_ids(data: bytes, n: int, lanes: int, vocab: int) -> np.ndarray:
    """The n ids that encode_ids coded into data."""
    if not n:
        return np.zeros(0, "<u4")
    steps, size = -(-n // lanes), struct.unpack_from("<I", data)[0]
    ends = np.cumsum(np.frombuffer(zlib.decompress(data[4 : 4 + size]), "<u4", lanes)).astype(np.int64)
    at = np.concatenate(([0], ends[:-1]))
    words = np.append(np.frombuffer(data[4 + size :], "<u4"), 0).astype(np.uint64)
    none = len(words) - 1

    def take(who):
        pos = at[who]
        at[who] = pos + 1
        return words[np.where(pos < ends[who], pos, none)]

    every = np.arange(lanes)
    code = take(every) << HALF
    code |= take(every)
    mixer = Mixer(vocab, lanes, True)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    last1 = last2 = np.zeros(lanes, np.int64)
    grid, most = np.zeros((steps, lanes), np.int32), np.uint64((1 << int(TOTAL)) - 1)
    for step in range(steps):
        mixer.predict(last1, last2)
        r = rng >> TOTAL
        x = grid[step] = mixer.find(np.minimum((code - low) // r, most).astype(np.int32))
        start, size = mixer.interval(x)
        low += r * start
        rng = r * size
        who, _ = _settle(low, rng)
        code[who] = (code[who] << HALF) | take(who)
        mixer.learn(x)
        last1, last2 = x.astype(np.int64), last1
    return np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")


def encode_block(docs: list[tuple[int, bytes]], vocab: int, before: int = 0) -> bytes:
    """A block of (doc_id, ids as little-endian unsigned 32-bit integers); before: ids that precede it in its file."""
    data = b"".join(d[1] for d in docs)
    ids = np.frombuffer(data, "<u4")
    table = zlib.compress(np.diff(np.array([0, *(d[0] for d in docs)], "<i8")).tobytes() + np.array([len(d[1]) // 4 for d in docs], "<u4").tobytes())
    body = HEAD.pack(len(docs), len(ids), _lanes(len(ids)), vocab, before, zlib.crc32(data), len(table)) + table + encode_ids(ids, vocab)
    return FRAME.pack(MAGIC, zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, number of ids of each document, all ids, and how many precede them in the file; ValueError if the block is damaged."""
    body = memoryview(block)[FRAME.size :]
    if len(block) < FRAME.size + HEAD.size or FRAME.unpack_from(block) != (MAGIC, zlib.crc32(body)):
        raise ValueError("not a whole token block")
    n_docs, n, lanes, vocab, before, crc, size = HEAD.unpack_from(body)
    table = zlib.decompress(body[HEAD.size : HEAD.size + size])
    ids = decode_ids(body[HEAD.size + size :], n, lanes, vocab)
    if zlib.crc32(ids) != crc:
        raise ValueError("the checksum of a token block does not hold")
    return np.cumsum(np.frombuffer(table, "<i8", n_docs)), np.frombuffer(table, "<u4", n_docs, 8 * n_docs), ids, before


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS, remembered: int = 350_000) -> None:
    """Encodes every text (null: empty), appends end_id, and writes blocks and manifest to the folder `path`.

    The folder must not hold tokens already. Documents are dealt by ranges of doc_id (and text hash, so that rows of one doc_id can be parted), so the
    text is what is shuffled, once. A document lies in one block; a block ends with the document that brings it to
    block_ids. Repeated doc_ids follow one another in the order of their texts' hashes. A null doc_id comes first, and is
    null again when read. An empty table gives a manifest without rows. remembered: words whose ids a worker keeps at hand, at most, and as many from before.
    """

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_cache(tokenizer, True, remembered), np.array([end_id], "<u4").tobytes()
        vocab = max(cache.n_ids, end_id + 1)
        file_no, block_no, held, size, before = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            rows = [[file_no], [block_no], [len(held)], [size], [encode_block(held, vocab, before)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["file_no", "block_no", "n_docs", "n_tokens", "block"])

        for ids, texts in text_runs(it):
            for doc, got in zip(ids, cache.encode(texts)):
                held.append((doc, got + end))
                size += len(got) // 4 + 1
                if size >= block_ids:
                    yield flush()
                    block_no, held, size, before = block_no + 1, [], 0, before + size
        if held:
            yield flush()

    rows = doc_texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("long"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(code, BLOCKS).write.mode("errorifexists").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("file_no").agg(F.count("*").alias("n_blocks"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # a row per file, so one task holds few
    files.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files in `path`: doc_id, start, n_tokens, ids_crc32.

    Every block is decoded and its checksums held against it (ValueError in the task if one does not hold). start counts the ids of all documents before.
    """

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                docs, lengths, ids, before = decode_block(batch.column(1)[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crcs = np.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
                file_no = np.full(len(docs), batch.column(0)[i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(file_no), pa.array(starts + before), pa.array(lengths.astype(np.int64)), pa.array(crcs)], names=["doc_id", "file_no", "_in_file", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("file_no", "block").mapInArrow(decode, DOCS)
    files = spark.read.parquet(f"{path}/manifest").select("file_no", "start")
    return rows.join(files, "file_no").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("start") + F.col("_in_file")).alias("start"), "n_tokens", "ids_crc32")
