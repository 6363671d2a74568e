"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

The words of each source form one stream, in an order that hashes of its rows give. Streams are cut into
blocks of so many words, which are drawn in a random order without a repeat until all are, then once more, until the source's
target is met; its last block is cut short. So a source gives its target to the word, whatever the lengths of its texts.
How many draws of each source go to each output shard is settled on the driver by a tree: a range
of shards is halved, and the draws of the left half are multivariate hypergeometric in those of the range, so the shards
are as if all draws had been shuffled at once, with exact totals on both sides. Draws then find their
shards by themselves, and each shard is shuffled within.

The order of blocks is a permutation that is worked out block by block, so nothing is sorted by source. What the driver
holds and broadcasts are sources (an error above MOST_SOURCES) and draws by source and shard (blocks grow so that they stay under MOST_CELLS).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_texts, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
WORD_ENDS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"  # before each word but the first
MOST_SOURCES, MOST_CELLS = 100_000, 1 << 22
MOST_DRAWS = 500_000_000  # numpy draws hypergeometric numbers of under 10^9 items
CHUNK_ROWS, MOST_CHUNKS = 32, 200_000  # rows whose places in a stream are counted together, at least; such chunks, about
ROUNDS = 48
STEP = 0x9E3779B97F4A7C15
KEY = ("_source", "doc_id", "text_hash", "_part", "_nth")  # tells rows apart; rows that are alike are numbered


class Mix(NamedTuple):
    """rows: one row per document: KEY, source, size, source_size, target. spans: what the mix takes, in its order:
    shard, place (in its shard, from 0), KEY, source, first_word, n_words (of the document) and again (0: first draw of these words)."""

    rows: DataFrame
    spans: DataFrame


def hashed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The place of x in a permutation of 0 to n - 1, by swap-or-not rounds: x and its partner swap places or not, as a hash of both says."""
    x, n, seed = x.astype(np.uint64), n.astype(np.uint64), seed.astype(np.uint64)
    for number in range(ROUNDS):
        key = hashed(seed + np.uint64((number + 1) * STEP % 2**64))
        partner = (key % n + n - x) % n
        swap = hashed(key ^ hashed(np.maximum(x, partner) + np.uint64(STEP))) >> np.uint64(63) == 1
        x = np.where(swap, partner, x)
    return x.astype(np.int64)


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction, most: int) -> list[Fraction]:
    """Shares of share * sum(sizes) by weight, none above most times its size: what is above goes to the others by weight, until none is."""
    out, free, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        full = [i for i in free if level * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free = [i for i in free if level * weights[i] <= most * sizes[i]]
    return out


def draws_for(words: int, size: int, block: int, seed: int) -> tuple[int, int]:
    """How many draws of blocks give so many words of a stream of that size, and how many words of the last one count."""
    if words <= 0:
        return 0, 0
    n = -(-size // block)
    short = n * block - size  # by so much the last block of the stream is shorter
    at = int(permuted(np.array([n - 1]), np.array([n]), np.array([seed], np.uint64))[0])  # when it is drawn
    times, rest = divmod(words - 1, size)
    rest += 1  # 1 to size
    m = -(-rest // block)
    if m > at:
        m = -(-(rest + short) // block)
    return times * n + m, rest - ((m - 1) * block - short * (m - 1 > at))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws by source (row) and shard (column): rows sum to the quotas, columns differ by one at most, all such tables as likely as a shuffle of all draws makes them."""
    total = int(quotas.sum())
    ends = [total * j // shards for j in range(shards + 1)]
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[:, low] = held
            continue
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low * (shards + 1) + high]))  # each node has numbers of its own
        left = rng.multivariate_hypergeometric(held, ends[middle] - ends[low], method="marginals")
        todo += [(low, middle, left), (middle, high, held - left)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """Rows that are alike as one: source, doc_id, text_hash, _part (its input partition, so that no count is large), size and _n, how many they are."""
    rows = doc_texts(docs, "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("_size"))
    rows = rows.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), F.spark_partition_id().alias("_part"), F.coalesce("_size", F.lit(0).cast("long")).alias("size"))
    return rows.groupBy("source", "doc_id", "text_hash", "_part", "size").agg(F.count("*").alias("_n"))


def placed(units: DataFrame, n_rows: int) -> DataFrame:
    """Adds start, the words of the same source before each unit, units without words left out. Places are counted in chunks by hash, then over chunks."""
    chunk = max(CHUNK_ROWS, -(-n_rows // MOST_CHUNKS))
    own = F.xxhash64("text_hash", "doc_id")
    words = units.filter("size > 0").withColumn("_hash", own).withColumn("_chunk", F.shiftrightunsigned("_hash", 1) % F.greatest(F.lit(1), F.ceil(F.col("_rows") / chunk)))
    total = F.col("size") * F.col("_n")
    sums = words.groupBy("_source", "_chunk").agg(F.sum(total).alias("_sum"))
    sums = sums.withColumn("_group", F.shiftrightunsigned("_chunk", 8))  # so that the chunks of a large source are not in one task
    groups = sums.groupBy("_source", "_group").agg(F.sum("_sum").alias("_all")).withColumn("_base", F.sum("_all").over(Window.partitionBy("_source").orderBy("_group")) - F.col("_all")).drop("_all")
    within = F.sum("_sum").over(Window.partitionBy("_source", "_group").orderBy("_chunk")) - F.col("_sum")
    before = sums.withColumn("_before", within).join(groups, ["_source", "_group"]).select("_source", "_chunk", (F.col("_before") + F.col("_base")).alias("_before"))
    order = Window.partitionBy("_source", "_chunk").orderBy("_hash", "text_hash", "doc_id", "_part").rowsBetween(Window.unboundedPreceding, 0)
    run = words.withColumn("_upto", F.sum(total).over(order)).withColumn("_own", total).join(before, ["_source", "_chunk"])
    return run.withColumn("start", F.col("_before") + F.col("_upto") - F.col("_own")).drop("_before", "_upto", "_own", "_hash", "_chunk")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, block_words: int = 2048, shard_blocks: int = 4096, seed: int = 1) -> Mix:
    """Mixes all rows of docs (doc_id, text, source) to the sources' targets: share of all words by weight, at most `most` times a source's own.

    Weights go to the sources in order of code points, null last, and repeat. A text's size is the number of its words, runs of other
    than spaces and \\t to \\r; null texts have none. Each source gives its target, rounded to a word (halves up). No word is taken
    more than `most` times. Rows that repeat an id or a text are mixed each for itself; an empty table gives no rows. The same rows give the same mix, however they are dealt to files.
    """
    spark = docs.sparkSession
    units = materialize(sized(docs), "sized")
    of = units.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size"), F.sum("_n").alias("_rows")).limit(MOST_SOURCES + 1).collect()
    if len(of) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    of.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in of]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(of))], Fraction(share), most)
    words = [int(g + Fraction(1, 2)) for g in goals]
    block = max(block_words, -(-sum(words) // MOST_DRAWS))
    seeds = hashed(np.arange(len(of), dtype=np.uint64) + np.uint64(seed * STEP % 2**64))
    drawn = [draws_for(w, z, block, int(s)) for w, z, s in zip(words, sizes, seeds)]
    quotas = np.array([q for q, _ in drawn], np.int64)
    shards = max(1, min(-(-int(quotas.sum()) // shard_blocks), MOST_CELLS // max(1, len(of))))
    firsts = np.cumsum(np.hstack([np.zeros((len(of), 1), np.int64), split(quotas, shards, seed)]), 1)[:, :-1]
    blocks, last = np.array([max(1, -(-z // block)) for z in sizes], np.int64), np.array([n for _, n in drawn], np.int64)
    keys = (firsts + (np.arange(len(of), dtype=np.int64) << 32)[:, None]).ravel()  # draws are under 2**30
    plan = spark.sparkContext.broadcast((keys, quotas, last, blocks, seeds))

    names = spark.createDataFrame([(i, r.source, z, float(g), r._rows) for i, (r, z, g) in enumerate(zip(of, sizes, goals))], "_source int, source string, source_size long, target double, _rows long")
    known = units.join(F.broadcast(names), units.source.eqNullSafe(names.source)).drop(names.source)  # MOST_SOURCES rows at most
    nth = F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_nth")
    rows = known.select("_source", "doc_id", "text_hash", "_part", nth, "source", "size", "source_size", "target")
    single = placed(known, sum(r._rows for r in of)).select("_source", "doc_id", "text_hash", "_part", nth, "source", "size", "start")
    single = single.withColumn("start", F.col("start") + F.col("_nth") * F.col("size"))
    kept = [*KEY, "source"]

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, quotas, last, blocks, seeds = plan.value
        for batch in it:
            s, size, start, ident = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_source", "size", "start", "text_hash"))
            first, count = start // block, (start + size - 1) // block - start // block + 1
            row = np.repeat(np.arange(len(s)), count)
            b = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low, high = np.maximum(start[row], b * block), np.minimum(start[row] + size[row], (b + 1) * block)
            s = s[row]
            at = permuted(b, blocks[s], seeds[s])
            found = []
            for again in range(most):
                q = again * blocks[s] + at
                end = np.where(q == quotas[s] - 1, np.minimum(high, b * block + last[s]), high)
                some = np.flatnonzero((q < quotas[s]) & (end > low))
                key = (s[some].astype(np.int64) << 32) + q[some]
                shard = (np.searchsorted(keys, key, "right") - 1) % (len(keys) // len(quotas))
                order = hashed(key.astype(np.uint64) * np.uint64(STEP) ^ ident[row[some]].astype(np.uint64)).view(np.int64)
                found.append((row[some], shard, order, low[some] - start[row[some]], end[some] - low[some], np.full(len(some), again)))
            row, *columns = (np.concatenate(c) for c in zip(*found))
            some = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(some) for c in kept), *(pa.array(c.astype(np.int64)) for c in columns)], names=[*kept, "shard", "_order", "first_word", "n_words", "again"])

    types = dict(single.dtypes)
    spans = single.mapInArrow(draw, ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} long" for c in ("shard", "_order", "first_word", "n_words", "again")]))
    within = Window.partitionBy("shard").orderBy("_order", "_source", "doc_id", "text_hash", "_part", "_nth", "first_word", "again")  # a shard is of bounded size
    spans = materialize(spans.select("shard", (F.row_number().over(within) - 1).cast("long").alias("place"), *kept, "first_word", "n_words", "again"), "mixed")
    rows = materialize(rows, "mixed-rows")
    release(spark, units)
    return Mix(rows, spans)


def taken(mixed: Mix) -> DataFrame:
    """The words that the mix takes of each document, repeats counted: rows of the mix and taken (0 where it takes none)."""
    sums = mixed.spans.groupBy(*KEY).agg(F.sum("n_words").alias("taken"))
    x, y = mixed.rows.alias("x"), sums.alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in KEY]
    return x.join(y, same, "left").select("x.*", F.coalesce("y.taken", F.lit(0).cast("long")).alias("taken"))


def with_texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The spans with their texts: from the first letter of the first word up to the next span's first word, or the text's end."""
    texts = doc_texts(docs).withColumn("_hash", F.xxhash64("text")).dropDuplicates(["_hash", "doc_id"]).withColumnRenamed("doc_id", "_doc").select("_doc", "_hash", F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), WORD_ENDS).alias("_words"))
    both = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    piece = F.array_join(F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), "")
    return both.select(*spans.columns, piece.alias("text"))
