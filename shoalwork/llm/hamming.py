"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits (the signs of a vector) are cut into m segments of about log2(n) bits, and codes are indexed by
every segment's value. Round r looks up the values that differ from a query's in exactly r bits, in
every segment. After it, every code at a distance of up to m * (r + 1) - 1 has been met, since a farther
one alone can differ by more than r bits in all segments. A query is done once its kth distance lies within
that; so results are exact. A round that would look up more values for a query than there are codes is replaced by a scan of the codes for the
queries that are left, which is exact too.

Equal codes are one index entry, which carries the k + 1 smallest ids (more can't be among a query's k),
so copies of one vector never meet in one task.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, release

BLOCK, LEAST_SCAN = 1024, 4096  # queries held against all codes at a time; values looked up for a query in a round that are never too many
WORD = 32  # bits of a code kept in one long; segments lie within one


def sign_words(vector: Column, dims: int) -> list[Column]:
    """The signs of a vector as longs of 32 bits: 1 for values over 0; others, null and NaN are 0."""
    out = []
    for at in range(0, dims, WORD):
        bits = [F.when((F.get(vector, i) > 0) & ~F.isnan(F.get(vector, i)), F.lit(1 << (i - at)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(at, min(at + WORD, dims))]
        out.append(sum(bits[1:], bits[0]))
    return out


def distance(a: str, b: str, words: int) -> Column:
    parts = [F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in range(words)]
    return sum(parts[1:], parts[0])


def segment_bounds(dims: int, n: int) -> list[tuple[int, int]]:
    """First bit and size of each segment; none crosses a long's end."""
    size = min(20, max(4, round(math.log2(max(n, 2)))))
    out = []
    for at in range(0, dims, WORD):
        bits = min(WORD, dims - at)
        count = max(1, round(bits / size))
        cuts = [at + bits * i // count for i in range(count + 1)]
        out += [(a, b - a) for a, b in itertools.pairwise(cuts)]
    return out


def segment_values(prefix: str, bounds: list[tuple[int, int]]) -> Column:
    """An array of (segment, value)."""
    return F.array(*(
        F.struct(F.lit(j).alias("segment"), F.shiftright(F.col(f"{prefix}{a // WORD}"), a % WORD).bitwiseAND(F.lit((1 << n) - 1)).alias("value"))
        for j, (a, n) in enumerate(bounds)
    ))


def masks(bits: int, radius: int) -> Column:
    """All values of `bits` bits with `radius` of them set, as an array."""
    got = [sum(1 << b for b in c) for c in itertools.combinations(range(bits), radius)]
    return F.from_json(F.lit(json.dumps(got)), "array<bigint>")


def smallest_ids(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The smallest distinct ids of each key, at most `most`, first in salted parts."""
    part = Window.partitionBy(*keys, "_salt").orderBy("id")
    few = rows.distinct().withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= most)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("id")), 1, most).alias("ids"))


def scan(index: DataFrame, pending: DataFrame, k: int, words: int) -> list[DataFrame]:
    """The k nearest of all codes to each pending query, BLOCK queries at a time: for queries so far from all codes that a round would look up more
    values than there are codes."""
    blocks, d, out = max(1, -(-pending.count() // BLOCK)), distance("q", "c", words), []
    for b in range(blocks):
        some = F.broadcast(pending.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))  # about BLOCK rows
        met = index.join(some, d <= F.col("kth")).select("query_id", d.alias("distance"), F.explode("ids").alias("neighbor_id")).filter("query_id <> neighbor_id")
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))).filter(F.col("rank") <= k)
        out.append(materialize(ranked.drop("rank"), "scanned"))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by Hamming distance of signs, ties by id, the query's own id left out.

    Returns query_id, rank (from 1), neighbor_id, distance. Rows with a null id or vector are neither
    searched nor found; rows that repeat an id with the same signs count once. Vectors shorter than the
    longest have zeros at their end. Fewer than k other rows: all of them. No rows: an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")).filter("query_id is not null and v is not null")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    words = -(-dims // WORD)
    codes = [f"c{w}" for w in range(words)]
    own = [f"q{w}" for w in range(words)]
    index = materialize(smallest_ids(rows.select("id", *(c.alias(n) for c, n in zip(sign_words(F.col("v"), dims), codes))), codes, k + 1), "codes")
    asked = asked.select("query_id", *(c.alias(n) for c, n in zip(sign_words(F.col("v"), dims), own))).distinct()
    n = index.count()
    bounds = segment_bounds(dims, n)
    most = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    by_segment = index.select("*", F.explode(segment_values("c", bounds)).alias("s")).select("*", "s.segment", "s.value").drop("s")
    pending = materialize(asked.select("*", F.lit(dims).cast("int").alias("kth")), "queries")
    best, done, written = None, None, [index, pending]
    for radius in range(max(b for _, b in bounds) + 1):
        covered, before = len(bounds) * (radius + 1) - 1, len(bounds) * radius - 1
        lists = [(j, size) for j, (_, size) in enumerate(bounds) if size >= radius]
        if sum(math.comb(size, radius) for _, size in lists) > max(n, LEAST_SCAN):
            rest = scan(index, pending, k, words)
            written += rest
            done = reduce(DataFrame.unionByName, rest, done) if done is not None else reduce(DataFrame.unionByName, rest)
            break
        choice = F.lit(None).cast("array<bigint>")
        for size in sorted({s for _, s in lists}):
            choice = F.when(F.col("s.segment").isin([j for j, s in lists if s == size]), masks(size, radius)).otherwise(choice)
        probes = (
            pending.select("*", F.explode(segment_values("q", bounds)).alias("s"))
            .select("query_id", "kth", *own, "s.segment", F.col("s.value").alias("_value"), F.explode(choice).alias("_mask"))
            .select("query_id", "kth", *own, "segment", F.col("_value").bitwiseXOR(F.col("_mask")).alias("value"))
        )
        d = distance("q", "c", words)
        met = (  # what is nearer was met before; what is farther than the kth can't come in
            probes.hint("merge").join(by_segment, (probes.segment == by_segment.segment) & (probes.value == by_segment.value) & (d > before) & (d <= F.col("kth")))
            .select("query_id", d.alias("distance"), F.explode("ids").alias("neighbor_id"))
            .filter("query_id <> neighbor_id")
        )
        if best is not None:
            met = met.unionByName(best)
        ranked = met.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))).filter(F.col("rank") <= k)
        best = nearest = materialize(ranked.drop("rank"), "nearest")
        kth = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
        after = pending.join(kth, "query_id", "left").select("query_id", *own, F.when(F.col("_n") >= k, F.col("_far")).otherwise(F.lit(dims)).cast("int").alias("kth"), F.coalesce("_n", F.lit(0)).alias("_n"))
        after = materialize(after, "queries")
        written += [nearest, after]
        open_ = after.filter((F.col("kth") > covered) & (F.col("_n") < F.lit(most))).drop("_n")
        closed = best.join(after.filter(~((F.col("kth") > covered) & (F.col("_n") < F.lit(most)))).select("query_id"), "query_id", "left_semi")
        done = closed if done is None else done.unionByName(closed)
        best = best.join(open_.select("query_id"), "query_id", "left_semi")
        pending = open_
        if covered >= dims or pending.isEmpty():
            break
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = materialize(done.select("query_id", F.row_number().over(order).alias("rank"), "neighbor_id", "distance"), "top-k")
    release(vectors.sparkSession, *written)
    return out
