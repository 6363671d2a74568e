"""Removal of byte strings that occur more than once, by bucket-pointer refinement over the whole corpus.

A suffix's bucket at depth h is named by a 64-bit hash of its first h bytes, and the name at depth 2h is made of
the names at depth h of the suffix and of the suffix h bytes on, so names of one depth are reused for the
next. The refinement ends at `length` bytes: a bucket of that depth with two suffixes is a repeat. Suffixes
are sorted out level by level, and only those whose bucket has company go on:

1. Among the q-grams of every window of `length` bytes the one with the least name is the window's anchor. Equal windows
   have equal anchors, so windows whose anchor's q-gram bucket has one member are unique. One row per anchor
   (about one in seventy bytes) is counted.
2. Windows of one anchor are named together by the names of the first and the last. If all of them occur
   together elsewhere, they are repeats, which settles the inside of every long repeat.
3. The windows of the anchors that remain (the edges of repeats) are counted one by one at full depth.

Every level is a count with partial aggregation, so a passage in a third of all documents costs no task
more than its share. Unequal strings with one name: a chance of 2**-64 for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release, small_batches

BUFFER, SEGMENT, POSITION_BITS = 1 << 16, 1 << 19, 20
PASSES = 3  # the names of single windows are counted part by part, which bounds the disk that shuffles take
RUN_BITS = 16  # a run of windows is one long: its first window, and in so many bits how many more there are
ANCHORS = "uid long, anchor long, context long, run long"
WINDOWS = "uid long, w long, p int"
RESULT = "uid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
_BYTE_NAMES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_A, _B, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _A
    x ^= b
    x *= _B
    x ^= x >> _HALF
    return x


def names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of all suffixes at the anchors' depth q and at depth `length`, and q (a power of two)."""
    q = 1 << max(0, (length // 3).bit_length() - 1)
    current, size, at, full = _BYTE_NAMES[data], 1, length, None
    n = len(data) - length + 1
    while True:
        if length & size:  # the depths that add up to `length`, largest first in the string
            at -= size
            part = current[at : at + n]
            full = part if full is None else pair(part, full)
        if size == q:
            short = current
        if 2 * size > length:
            return short, full, q
        current = pair(current[:-size], current[size:])
        size *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` values in a row."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """Anchor name, context name, first window and number of further windows of every run of windows
    with one anchor, in a buffer of documents that end at `ends`."""
    short, full, q = names(data, length)
    keys = (short >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(short), dtype=np.uint64)
    anchor = (sliding_least(keys, length - q + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    valid = np.ones(len(full), bool)
    for end in ends[:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    of = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1))))
    lo, hi, of = at[first], at[np.concatenate((first[1:], [len(at)])) - 1], of[first]
    context = pair(pair(full[lo], full[hi]), ((hi - lo) << 20 | (of - lo)).astype(np.uint64))
    return short[of].view(np.int64), context.view(np.int64), lo, (hi - lo)


def buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """Texts put together into buffers, long ones in overlapping segments: data, index of each text,
    where each begins in the buffer, and where that place lies in the text."""
    held, index, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > SEGMENT:
            for s in range(0, len(text) - length + 1, SEGMENT):
                yield np.frombuffer(text[s : s + SEGMENT + length - 1], np.uint8), [i], np.array([0]), np.array([s])
            continue
        held.append(text)
        index.append(i)
        size += len(text)
        if size >= BUFFER:
            yield np.frombuffer(b"".join(held), np.uint8), index, np.cumsum([0, *map(len, held[:-1])]), np.zeros(len(held), np.int64)
            held, index, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), index, np.cumsum([0, *map(len, held[:-1])]), np.zeros(len(held), np.int64)


def uid() -> Column:
    """A 64-bit hash of doc_id and text; nulls count like the least long and the empty text."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-(2**63))).cast("long"), F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(uid().alias("uid"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


def _find_anchors(docs: DataFrame, length: int) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for data, index, starts, shift in buffers(batch.column(1).to_pylist(), length):
                found = anchors_of(data, np.append(starts[1:], len(data)), length)
                if found:
                    anchor, context, lo, n = found
                    k = np.searchsorted(starts, lo, "right") - 1
                    arrays = (uids[np.array(index)[k]], anchor, context, (lo - starts[k] + shift[k]) << RUN_BITS | n)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["uid", "anchor", "context", "run"])

    return _keyed(docs).filter(F.octet_length("bytes") >= length).mapInArrow(work, ANCHORS)


def bounds(runs: list[int] | None) -> list[tuple[int, int]]:
    """First and last window of each run."""
    return [(r >> RUN_BITS, (r >> RUN_BITS) + (r & ((1 << RUN_BITS) - 1))) for r in runs or ()]


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Names at full depth of the windows of the runs `edges` of each row."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, (text, runs) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                data, runs = np.frombuffer(text.as_buffer(), np.uint8), sorted(set(bounds(runs)))
                places, found, begin = [], [], 0
                while begin < len(runs):  # runs that lie close together share their names
                    end, (base, stop) = begin + 1, runs[begin]
                    while end < len(runs) and runs[end][0] < stop + 4 * length and runs[end][0] - base < SEGMENT:
                        stop = max(stop, runs[end][1])
                        end += 1
                    _, full, _ = names(data[base : stop + length], length)
                    p = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in runs[begin:end]]))
                    places.append(p)
                    found.append(full[p - base])
                    begin = end
                if places:
                    p = np.concatenate(places)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), uids[i])), pa.array(np.concatenate(found).view(np.int64)), pa.array(p.astype(np.int32))], names=["uid", "w", "p"])

    return rows.mapInArrow(work, WINDOWS)


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that windows beginning in the runs (first, last) cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def _remove(rows: DataFrame, length: int, keep: bool) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for key, text, runs, single in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = covered(bounds(runs) + [(p, p) for p in single or ()], length)
                view, sha, parts, at = memoryview(text.as_buffer()), hashlib.sha256(), [], 0
                for a, b in [*spans, (len(view), len(view))]:
                    sha.update(view[at:a])
                    if keep:
                        parts.append(view[at:a])
                    at = b
                rows.append((key, sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [{"start": a, "end": b} for a, b in spans], b"".join(parts).decode("utf-8", "ignore") if keep else None))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["uid", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.mapInArrow(work, RESULT)


def repeats(docs: DataFrame, length: int = 200, keep: bool = False) -> DataFrame:
    """The stretches of every text that lie in a string of `length` bytes that also starts anywhere else.

    Returns one row for each text with such bytes: uid (hash of doc_id and text), n_removed, n_spans, kept_sha256 of
    the remaining bytes, spans (start, end) and, if asked for, kept (the text of the remaining bytes; those left
    of a character cut in two are dropped). Matches lie within one
    document; overlapping ones in the same document count, and so do rows that repeat another. Null
    texts count as empty. Rows alike in doc_id and text give rows alike.
    """
    if length >= 1 << RUN_BITS:
        raise ValueError(f"length must be under {1 << RUN_BITS}")
    spark = docs.sparkSession
    every = materialize(_find_anchors(docs, length), "anchors")
    company = materialize(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "company")  # a table, so that Spark can split a hot anchor in the join
    found = materialize(every.join(company, "anchor", "left_semi"), "anchors")
    release(spark, every, company)
    place = F.xxhash64("uid", "run")
    contexts = found.groupBy("anchor", "context").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    mixed = found.groupBy("anchor").agg(F.min("context").alias("_a"), F.max("context").alias("_z")).filter("_a <> _z")  # anchors of several contexts
    mixed = materialize(mixed.select("anchor", F.lit(True).alias("several")), "mixed")  # a table again, for the same reason
    whole = F.col("c") > 1
    edge = F.coalesce("several", F.lit(False)) & ((F.col("c") == 1) | (place == F.col("first")))
    # by merging even where `mixed` is small: a broadcast would leave contexts dealt as they were counted, and the next join could not split a hot one
    told = found.join(contexts.join(mixed.hint("merge"), "anchor", "left"), ["anchor", "context"]).filter(whole | edge)
    runs = told.groupBy("uid").agg(F.collect_set(F.when(whole, F.col("run"))).alias("whole"), F.collect_set(F.when(edge, F.col("run"))).alias("edges"))
    runs = materialize(runs, "runs")  # a document's own anchors, each once, so no longer than the document
    release(spark, found, mixed)
    texts = _keyed(docs).filter(F.octet_length("bytes") >= length)
    edges = texts.join(runs.filter(F.size("edges") > 0).select("uid", "edges"), "uid").select("uid", "bytes", "edges")
    windows = materialize(_windows(edges, length), "windows")
    release(spark)
    found = []
    for k in range(PASSES):
        some = windows.filter(F.pmod("w", F.lit(PASSES)) == k)
        twice = materialize(some.groupBy("w").count().filter("count > 1").select("w"), "twice")
        release(spark)
        found.append(materialize(some.join(twice, "w", "left_semi").select("uid", "p"), "repeated"))
        release(spark, twice)
    single = reduce(DataFrame.unionByName, found).groupBy("uid").agg(F.collect_set("p").alias("single"))
    release(spark, windows)
    places = runs.select("uid", "whole").join(single, "uid", "left").filter((F.size("whole") > 0) | F.col("single").isNotNull())
    return _remove(texts.join(places, "uid").select("uid", "bytes", "whole", "single"), length, keep)


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans."""
    text = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", uid().alias("uid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    found = repeats(docs, length).drop("kept").dropDuplicates(["uid"])
    none = F.lit(0).cast("long")
    return every.join(found, "uid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), "spans",
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the repeated bytes taken out of text; bytes left of a character cut in two go as well."""
    new = repeats(docs, length, keep=True).select(F.col("uid").alias("_uid"), F.col("kept").alias("_text")).dropDuplicates(["_uid"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), uid().alias("_uid"))
    return rows.join(new, "_uid", "left").select(*(F.coalesce("_text", "_row.text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
