"""Document fingerprints: bottom-k sketches of hashed word shingles, in Spark SQL functions alone.

A sketch is the sorted array of the k smallest distinct 32-bit hashes of a text's five-word shingles (a
text of fewer words is one shingle; one without words has none). Sketches of parts merge into the
sketch of the whole. Those with fewer than k hashes are the whole set, so all estimates are exact then.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_texts

K, WORDS = 256, 5
SPAN = float(1 << 32)


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters, marks and digits, lower-cased."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, words: int = WORDS) -> Column:
    """32-bit hashes of all runs of `words` word hashes; of all words together if there are fewer."""
    def run(i):
        return F.shiftrightunsigned(F.xxhash64(*(F.get(hashes, i + j) for j in range(words))), 32)

    return F.when(F.size(hashes) >= words, F.transform(F.sequence(F.lit(0), F.size(hashes) - words), run)).when(
        F.size(hashes) > 0, F.array(F.shiftrightunsigned(F.xxhash64(hashes), 32))
    ).otherwise(F.array().cast("array<bigint>"))


def bottom(values: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def with_sketch(rows: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column; null texts count as empty."""
    return (
        rows.withColumn("_hashes", word_hashes(F.coalesce(text, F.lit(""))))
        .withColumn(out, bottom(shingles(F.col("_hashes")), k))
        .drop("_hashes")
    )


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(rows: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group's sketches: keys and sketch.

    Hashes are first made distinct by partial aggregation, then ranked in 64 salted parts, of which the
    k smallest each are left, so no task holds a whole group.
    """
    hashes = rows.select(*keys, F.explode(sketch).alias("_hash")).distinct().withColumn("_salt", F.pmod(F.col("_hash"), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_hash")
    few = hashes.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= k)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index of two sketches' sets; 1 for two empty ones."""
    union = merge(a, b, k)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.when(a == b, 1.0).when(F.size(union) == 0, 1.0).otherwise(F.size(both) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    n_union = distinct_count(merge(a, b, k), k)
    both = resemblance(a, b, k) * n_union
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(both / distinct_count(a, k), F.lit(1.0)))


def to_text(a: Column) -> Column:
    """The hashes as hexadecimal digits, eight each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _ranges(bounds: list[tuple], key: Column) -> tuple[Column, Column]:
    """How many of the sorted bounds are at most the key, by bisection; and whether the last of those (see _range) is the key."""
    if not bounds:
        return F.lit(0), F.lit(False)
    table = F.from_json(F.lit(json.dumps([dict(zip("nab", bound)) for bound in bounds])), "array<struct<n:int,a:bigint,b:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))
    return found, F.coalesce(F.get(table, F.col("_range") - 1) == key, F.lit(False))


def with_next(docs: DataFrame, add, rows_each: int = 500, most: int = 8192) -> DataFrame:
    """Pairs each document with the next one in descending doc_id, and the last with the first.

    Returns doc_id, the other columns of add(rows with doc_id and text) and, for each such column c, the next
    row's as next_c. Rows that share a doc_id follow one another in the order of their texts' hashes;
    those without one come last. Rows are dealt into at most `most` ranges of (doc_id, text hash), so neither an
    outlying id nor a repeated one fills a task; rows alike in both stay together. Where the ranges begin is read off
    a sample of about eight rows for each, which decides on nothing else, and each range gets a copy of the next one's first row.
    """
    n = docs.count()
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("n"), F.bitwise_not(F.coalesce("doc_id", F.lit(0)).cast("long")).alias("a"), F.xxhash64("text").alias("b"))
    rows = doc_texts(docs).withColumn("_key", key)
    ranges = min(most, n // rows_each + 1)
    some = F.when(F.col("_chance") < 8 * ranges / max(n, 1), F.col("_key")) if ranges > 1 else F.lit(None)
    first, some = rows.select("_key", F.rand(7).alias("_chance")).agg(F.min("_key"), F.collect_list(some)).first()
    if first is None:
        first = (0, 0, 0)
    bounds = sorted(set(sorted(map(tuple, some))[8::8]) - {tuple(first)})
    found, leads = _ranges(bounds, F.col("_key"))
    opens = F.col("_key") == F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(first, ("int", "long", "long"), "nab")))

    def at(place: Column, copy: int) -> Column:
        return F.struct(place.alias("place"), F.lit(copy).alias("copy"))

    places = F.array(at(F.col("_range"), 0), F.when(leads, at(F.col("_range") - 1, 1)), F.when(opens, at(F.lit(len(bounds)), 1)))
    dealt = rows.withColumn("_range", found).withColumn("_at", F.explode(F.filter(places, lambda x: x.isNotNull())))
    dealt = dealt.select("doc_id", "text", "_key", F.col("_at.place").alias("_range"), F.col("_at.copy").alias("_copy")).repartition("_range")
    order = ["_copy", "_key", "text"]
    dealt = add(dealt.sortWithinPartitions("_range", *order))
    more = [c for c in dealt.columns if c not in ("doc_id", "_key", "_range", "_copy")]
    led = dealt.select("*", F.lead(F.struct(*more)).over(Window.partitionBy("_range").orderBy(*order)).alias("_next")).filter("_copy = 0")
    return led.select("doc_id", *more, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in more))


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, and of the text with its last third taken from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_shingles (estimated). Null texts count as empty; an empty text's fingerprint is empty, and two
    empty ones are alike (1). Columns other than doc_id and text are not read.
    """
    pairs = with_next(docs, lambda rows: with_sketch(rows, "text", "sketch", k))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.when(third > 0, edited).otherwise(F.col("text")).alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_text(a).alias("fingerprint"), to_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"), distinct_count(a, k).alias("n_shingles"),
    )
