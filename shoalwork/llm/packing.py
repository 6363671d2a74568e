"""Packing of tokenized documents by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `max_len` ids. Only the histogram of piece lengths (at most
max_len rows) reaches the driver, where lengths are placed longest first, each into the packing
patterns with the most room, whole pattern counts at a time; sequences that a length opens take as many of it as fit. Patterns then go back to the pieces by
their rank within their length. Ranks are counted in salted groups of bounded size.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_texts, materialize, release, text_runs, word_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SHIFT = 40  # a rank has at most so many bits


def spfhp(histogram: dict[int, int], max_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns (runs of a length and its copies, how many sequences follow it) for a histogram of lengths.

    Lengths go longest first into the pattern with the least filled sequences; a pattern that is
    taken only in part is split. Equal room: the pattern opened last. Where no pattern has room, new sequences are opened one by one, and each
    takes as many of the length as fit before the next is. So a sequence is opened only by a length that no earlier one has room for, and the contents
    of no two sequences fit in one.
    """
    room: dict[int, list[tuple[tuple, int]]] = {}  # free space: patterns as linked lists, newest last
    largest = 0

    def add(items, length: int, copies: int, count: int, free: int) -> None:
        nonlocal largest
        if items and items[0][0] == length:
            items, copies = items[1], copies + items[0][1]
        room.setdefault(free, []).append((((length, copies), items), count))
        largest = max(largest, free)

    for length in sorted(histogram, reverse=True):
        left, fit = histogram[length], max_len // length
        while left > 0:
            while largest and not room.get(largest):
                largest -= 1
            if largest >= length:
                free = largest
                items, count = room[free].pop()
                take = min(left, count)
                if count > take:
                    room[free].append((items, count - take))
                add(items, length, 1, take, free - length)
                left -= take
            else:
                for copies, count in ((fit, left // fit), (left % fit, 1)):
                    if copies and count:
                        add(None, length, copies, count, max_len - copies * length)
                left = 0
    out = []
    for free in sorted(room):
        for items, count in room[free]:
            runs = []
            while items:
                run, items = items
                runs.append(run)
            out.append((runs[::-1], count))
    return out


def intervals(patterns: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank), the sequence and offset that the first rank gets, and how many ranks in a row share a sequence."""
    keys, seqs, offsets, copied, used, base = [], [], [], [], {}, 0
    for runs, count in patterns:
        at = 0
        for length, copies in runs:
            lo = used.get(length, 0)
            keys.append((length << SHIFT) + lo)
            seqs.append(base)
            offsets.append(at)
            copied.append(copies)
            used[length] = lo + count * copies
            at += length * copies
        base += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(c, np.int64)[order] for c in (keys, seqs, offsets, copied))


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 2, remembered: int = 350_000) -> DataFrame:
    """One row per piece of a document: its place, length and the crc32 of its ids. remembered: words whose ids a worker keeps at hand, at most, and as many from before."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_cache(tokenizer, False, remembered), np.array([end_id], "<u4").tobytes()
        for ids, texts in text_runs(it):
            rows = []
            for doc, got in zip(ids, cache.encode(texts)):
                got += end
                n = len(got) // 4
                rows += [(doc, s, min(max_len, n - s), zlib.crc32(got[4 * s : 4 * (s + max_len)]), n) for s in range(0, n, max_len)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return doc_texts(docs).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, max_len: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length (1 to max_len).

    Any further columns are kept, but for those named sequence_id and offset, which are replaced. Rows of one doc_id and start are told apart by
    all their columns; rows that are wholly alike get places of their own. An empty table gives an empty one; null lengths are an error.
    """
    spark, given = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    held = F.struct(*(F.col(f"`{c}`") for c in given))
    pieces = pieces.select("doc_id", "start", "length", F.xxhash64(F.to_json(held)).alias("_tie"), held.alias("_row"))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most max_len rows
    plan = intervals(spfhp(histogram, max_len))
    group = max(256, -(-sum(histogram.values()) // 200_000))  # rows of a length ranked together; so at most 200,000 + max_len groups
    salts = spark.createDataFrame([(n, -(-c // group)) for n, c in histogram.items()] or [(0, 1)], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("_salts"))).drop("_salts")
    before = (
        salted.groupBy("length", "_salt").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "_tie"))).join(before, ["length", "_salt"])
    own = next(n for n in itertools.chain(["_rank"], (f"_rank{i}" for i in itertools.count())) if n not in given)
    ranked = ranked.select("_row.*", (F.col("_before") + F.col("_rank") - 1).alias(own))
    tables = spark.sparkContext.broadcast(plan)
    names = ranked.columns

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, offsets, copied = tables.value
        for batch in it:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", own))
            key = (length << SHIFT) + rank
            at = np.searchsorted(keys, key, "right") - 1
            nth = key - keys[at]
            columns = [batch.column(i) for i, c in enumerate(names) if c != own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seqs[at] + nth // copied[at]), pa.array(offsets[at] + nth % copied[at] * length)], names=[*(c for c in names if c != own), "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in ranked.schema if f.name != own), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 2, remembered: int = 350_000) -> DataFrame:
    """Packs whole documents (null text: empty, so the end id alone) into sequences.

    A document longer than max_len is cut at multiples of max_len; nothing else is cut. Returns one
    row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Rows that repeat
    a doc_id are packed each for itself.
    """
    pieces = materialize(token_pieces(docs, tokenizer, max_len, end_id, remembered), "pieces")
    out = materialize(pack(pieces, max_len), "packed")
    release(docs.sparkSession, pieces)
    return out
