"""Near-duplicate classes by BagMinHash signatures of shingle multisets.

A text's multiset of five-word shingles is sketched by Poisson processes: the weight axis of every
shingle is cut into (0,1], (1,2], (2,4], (4,8] ..., each piece has its own process, whose points come in ascending order and carry
a slot and a level, and points above the shingle's count are thinned out. A slot keeps the least point that
falls to it; two texts agree in a slot with the probability of their weighted Jaccard index. Processes
stop once they pass the largest slot. Bands of slots give candidates, and every candidate's multiset
overlap is counted out before it links two texts.

Equal texts are one node from the start. All pairs of a bucket are compared, each pair once over all its
buckets. Those of small buckets are rows. Each node of large buckets has the largest of them for its home, and two nodes of one home are
compared there alone. So a bucket whose nodes are at home in one other bucket is passed over, and one where few are not has only
those held against the rest. Nodes to be compared are dealt into blocks, at most 4 in a bucket of under 16,384 nodes and one for 4,096 above, and two
blocks at a time are compared by products of matrices, which puts out one row for each node (how many links it has, and
a node that all it reaches share). A node is sent once to each block of its bucket, with its elements, so rows are at most 4 times the nodes of buckets of that
size and grow by the nodes over 4,096 above, as n links a node take n comparisons to count. No link
between different texts is lost but by banding (under 1e-5 for a similarity of 0.8, less above) and by the comparison of
bit sketches that goes before small buckets' counts (six standard deviations, under 1e-8). Overlaps are counted on 32-bit hashes of the occurrences: in
a text of n words about n^2 / 2^33 of them fall together (one in a text of 90,000 words), which can tip a similarity that lies that close to the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._common import batches, doc_texts, materialize, release

WORDS, BANDS, ROWS = 5, 30, 5
SLOTS = BANDS * ROWS
WORD = re.compile(r"\w+")
TABLE_BITS = 16
LARGE = 32  # nodes of a bucket above which its pairs are not rows
LEAST_BLOCK, BLOCK_NODES, BLOCK_ELEMENTS = 512, 4096, 1 << 22  # nodes of a large bucket in a block, about, at least and at most; elements at most
TILE = 1024  # nodes of a block in one matrix
MAJOR = 1 << 30  # added to the numbers of blocks of nodes that are not held against one another
NO_ID = 2**63 - 1  # stands for a null doc_id
STEP = np.uint64(0x9E3779B97F4A7C15)
SIGNED = "doc_id long, node long, bands array<long>, s0 long, s1 long, s2 long, size int, elements array<int>"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; a text of fewer words than a shingle has is one shingle."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        h = np.concatenate((h, np.full(WORDS - len(h), len(h), np.uint64)))
    n = len(h) - WORDS + 1
    s = h[:n].copy()
    for j in range(1, WORDS):
        s = (s * np.uint64(0x9FB21C651E98DF25)) ^ h[j : j + n]
        s ^= s >> np.uint64(29)
    return np.unique(mix(s), return_counts=True)


def elements(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set of 32-bit hashes, one for every occurrence."""
    many = counts > 1
    out = [shingles]
    if many.any():
        c = counts[many]
        occurrence = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        more = mix(np.repeat(shingles[many], c) + occurrence.astype(np.uint64) * STEP)
        out.append(more[occurrence > 0])
    return np.unique((np.concatenate(out) >> np.uint64(32)).astype("<u4"))


_exp: list[np.ndarray] = []


def exponential_table() -> np.ndarray:
    """Minus logarithms of (i + 1) / 2**TABLE_BITS, between which points are interpolated."""
    if not _exp:
        _exp.append(-np.log(np.concatenate(([0.5], np.arange(1, (1 << TABLE_BITS) + 1))) / (1 << TABLE_BITS)))
    return _exp[0]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of slot minima for each bag; equal points are equal floats. An empty bag has infinities."""
    table = exponential_table()
    seed, doc, rate, lower, weight = [], [], [], [], []
    sizes = [len(b[0]) for b in bags]
    shingles = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    counts = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0, np.int64)
    docs = np.repeat(np.arange(len(bags)), sizes)
    for k in range(64):
        low = 0 if k == 0 else 1 << (k - 1)
        held = counts > low
        if not held.any():
            break
        seed.append(mix(shingles[held] + np.uint64(k * int(STEP) % 2**64)))
        doc.append(docs[held])
        weight.append(counts[held])
        rate.append(np.full(held.sum(), max(low, 1), np.float64))
        lower.append(np.full(held.sum(), low, np.int64))
    least = np.full(len(bags) * slots, np.inf)
    if not seed:
        return least.reshape(-1, slots)
    seed, doc, rate, lower, weight = map(np.concatenate, (seed, doc, rate, lower, weight))
    x, most, number = np.zeros(len(seed)), np.full(len(bags), np.inf), 0
    while len(seed):
        number += 1
        r = mix(seed + np.uint64(number * int(STEP) % 2**64))
        i = (r >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        part = ((r >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        x = x + (table[i] + (table[i + 1] - table[i]) * part) / rate
        keep = x < most[doc]
        if not keep.all():
            x, r, seed, doc, rate, lower, weight = x[keep], r[keep], seed[keep], doc[keep], rate[keep], lower[keep], weight[keep]
        r = mix(r ^ np.uint64(0xD6E8FEB86659FD93))
        slot = ((r >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        level = lower + ((r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        in_weight = level < weight
        np.minimum.at(least, (doc * slots + slot)[in_weight], x[in_weight])
        if number < 8 or number % 8 == 0:
            most = least.reshape(-1, slots).max(1)
    return least.reshape(-1, slots)


def band_keys(least: np.ndarray) -> np.ndarray:
    bits = least.view(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) * STEP), bits.shape[:2]).copy()
    for j in range(ROWS):
        key = mix((key ^ bits[:, :, j]) * STEP)
    return key.view(np.int64)


def bit_sketch(least: np.ndarray) -> np.ndarray:
    """One bit of every slot, in three longs."""
    bits = np.zeros((len(least), 192), np.uint8)
    bits[:, :SLOTS] = mix(least.view(np.uint64)) >> np.uint64(63)
    return np.packbits(bits, axis=1).view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its node (64-bit hash of the text), band keys, bit sketch and elements."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).to_pylist()
            for a, b in batches(texts, 1_500_000):
                bags = [shingle_bag(t) for t in texts[a:b]]
                least = signatures(bags)
                keys, bits = band_keys(least), bit_sketch(least)
                full = [len(bag[0]) > 0 for bag in bags]
                sets = [elements(*bag) for bag in bags]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([k if f else [] for k, f in zip(keys, full)], pa.list_(pa.int64())),
                     *(pa.array(bits[:, j]) for j in range(3)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32()))],
                    names=["doc_id", "node", "bands", "s0", "s1", "s2", "size", "elements"])

    return doc_texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text").mapInArrow(work, SIGNED)


def _may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and bit sketches leave room for the threshold: six standard deviations are given."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    differing = sum(F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(3))
    agree = (1 + threshold) / 2
    most = SLOTS * (1 - agree) + 6 * (SLOTS * agree * (1 - agree)) ** 0.5
    return (F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)) & (differing <= most)


def _overlaps(x: Column, y: Column, threshold: float) -> Column:
    """Whether two multisets, as sets of occurrences, overlap by the threshold."""
    both = F.size(F.array_intersect(x, y))
    return both >= F.lit(threshold) * (F.size(x) + F.size(y) - both) - 1e-9


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share. Elements that many sets hold are multiplied out, others paired off."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    dense = np.flatnonzero(times > 16)
    place = np.full(len(times), -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    for low in range(0, len(dense), 2048):
        here = (at >= low) & (at < low + 2048)
        x = np.zeros((n, min(2048, len(dense) - low)), np.float32)
        x[of[here], at[here] - low] = 1
        both += x @ x.T
    few = (at < 0) & (times[column] > 1)
    order = np.lexsort((of[few], column[few]))
    of, column = of[few][order], column[few][order]
    for k in range(1, 16):
        same = np.flatnonzero(column[k:] == column[:-k])
        if not len(same):
            break
        np.add.at(both, (of[same], of[same + k]), 1)
        np.add.at(both, (of[same + k], of[same]), 1)
    return both


def _linked(table: pa.Table, threshold: float, key: int, crossed: bool) -> np.ndarray:
    """Which pairs of a part's nodes are links that this bucket (key) counts: of one home in that bucket alone, others in the least bucket that they share."""
    block = table["block"].to_numpy()
    sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in table["elements"]]
    size, both = np.array([len(s) for s in sets], np.float64), _common_counts(sets).astype(np.float64)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if crossed:
        linked &= block[:, None] != block[None, :]
    home = table["home"].to_numpy()
    alike = home[:, None] == home[None, :]
    met = np.zeros(linked.shape, bool)  # in a bucket of lesser key
    before = [[k for k in keys if k < key] for keys in table["large"].to_pylist()]
    names = {k: i for i, k in enumerate(sorted({k for keys in before for k in keys}))}
    for low in range(0, len(names), 512):
        x = np.zeros((len(sets), min(512, len(names) - low)), np.float32)
        for i, keys in enumerate(before):
            for k in keys:
                if low <= names[k] < low + 512:
                    x[i, names[k] - low] = 1
        met |= x @ x.T > 0
    return linked & np.where(alike, (home == key)[:, None], ~met)


def _links_of_part(table: pa.Table, threshold: float) -> pa.Table:
    """node, n (its links to nodes of this part of a bucket) and root (the first of those it reaches by them).

    A part is one block, or two of which only pairs across count. Tiles of its nodes are compared two at a time.
    """
    key, crossed = table["key"][0].as_py(), table["low"][0].as_py() != table["high"][0].as_py()
    table = table.sort_by([("block", "ascending"), ("node", "ascending")]) if crossed else table.sort_by("node")
    nodes, block = table["node"].to_numpy(), table["block"].to_numpy()
    count, pairs = np.zeros(len(nodes), np.int64), []
    edges = np.flatnonzero(np.diff(block)) + 1 if crossed else []
    tiles = [(a, min(a + TILE, z)) for low, z in zip([0, *edges], [*edges, len(nodes)]) for a in range(low, z, TILE)]
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if crossed and block[a] == block[c]:
                continue
            own = np.arange(a, b) if a == c else np.concatenate((np.arange(a, b), np.arange(c, d)))
            linked = _linked(table.take(pa.array(own)), threshold, key, crossed)
            if a != c:  # pairs within a tile have their own turn
                linked[: b - a, : b - a] = False
                linked[b - a :, b - a :] = False
            count[own] += linked.sum(1)
            x, y = np.nonzero(np.triu(linked))
            root = np.arange(len(own))
            while len(x):  # each node's least neighbour's least neighbour and so on
                new = root.copy()
                np.minimum.at(new, x, root[y])
                np.minimum.at(new, y, root[x])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            moved = np.flatnonzero(root != np.arange(len(own)))
            pairs.append((own[moved], own[root[moved]]))
    root = np.arange(len(nodes))
    x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.table({"node": nodes, "n": count, "root": nodes[root]})


def _homes(hot: DataFrame) -> DataFrame:
    """node, large (the keys of its large buckets) and home (that of the largest)."""
    return hot.groupBy("node").agg(F.collect_list("key").alias("large"), F.max_by("key", F.struct("n", "key")).alias("home"))


def _dealt(hot: DataFrame, held: DataFrame) -> DataFrame:
    """Parts of large buckets that nodes are sent to: key, low, high, block, node. hot: key, node, size."""
    kinds = hot.select("key", "node", "size").join(held.select("node", "home"), "node")
    amounts = kinds.groupBy("key", "home").agg(F.count("*").alias("c"), F.sum("size").alias("e"))
    of = amounts.groupBy("key").agg(F.sum("c").alias("_c"), F.sum("e").alias("_e"), F.max(F.struct("c", "home", "e")).alias("m"))
    few = (F.col("_c") - F.col("m.c"), F.col("_e") - F.col("m.e"))
    blocks = lambda c, e: F.ceil(F.greatest(F.least(c / LEAST_BLOCK, F.lit(4.0)), c / BLOCK_NODES, e / BLOCK_ELEMENTS)).cast("int")
    whole = F.col("m.home") == F.col("key")  # most are at home here: all pairs, else all but those among most
    of = of.select("key", F.col("m.home").alias("_most"), whole.alias("_whole"), few[0].alias("_few"), blocks(F.col("_c"), F.col("_e")).alias("_blocks"), blocks(*few).alias("_few_blocks")).filter("_whole or _few > 0")
    rows = kinds.join(of, "key")
    own = lambda n: F.pmod(F.xxhash64("node", "key"), F.greatest(n, F.lit(1))).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    every, apart = own(F.col("_blocks")), own(F.col("_few_blocks"))
    part = lambda low, high, block: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), block.cast("int").alias("block"))
    among = lambda mine, n: F.transform(numbers(n), lambda o: part(F.least(mine, o), F.greatest(mine, o), mine))
    across = F.transform(numbers(F.col("_blocks")), lambda o: part(apart, o + MAJOR, apart))
    faced = F.transform(numbers(F.col("_few_blocks")), lambda o: part(o, every + MAJOR, every + MAJOR))
    sent = F.when(F.col("_whole"), among(every, F.col("_blocks"))).when(F.col("home") == F.col("_most"), faced).otherwise(F.concat(among(apart, F.col("_few_blocks")), across))
    return rows.select("key", "node", F.explode(sent).alias("_p")).select("key", "_p.*", "node")


def _compare_large(dealt: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Compares the nodes of each part; sets has node, elements, large and home."""
    rows = dealt.join(sets, "node").repartition("key", "low", "high")  # else rows dealt by key before would stay together, with all parts of a bucket in one task
    return rows.groupBy("key", "low", "high").applyInArrow(lambda table: _links_of_part(table, threshold), "node long, n long, root long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The class of every row: doc_id, class_id (the least doc_id of its class), n_links, text_hash (64 bits of the text)
    and leads (whether the text is the one that stands for its class: of those with its least doc_id the one of least hash).

    n_links counts all verified links of the row's text to other texts. Texts without a word are alike
    only when equal; null texts count as empty. Rows that repeat a doc_id each get a row.
    A class has a null class_id if none of its rows has a doc_id. Similarity is that of the
    multisets of five-word shingles (words: runs of letters, digits and underscores, lower-cased).
    """
    spark, parts = docs.sparkSession, None
    signed = materialize(sign(docs), "signed")
    texts = materialize(
        signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in ("s0", "s1", "s2", "size"))),
        "texts",
    )
    light = texts.select("node", "s0", "s1", "s2", "size")
    buckets = texts.select("node", "size", F.explode("bands").alias("key"))
    company = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(buckets.join(company, "key"), "buckets")  # buckets with company
    release(spark)

    def possible(pairs: DataFrame) -> DataFrame:
        near = pairs.join(light.alias("x"), F.col("a") == F.col("x.node")).join(light.alias("y"), F.col("b") == F.col("y.node"))
        return near.filter(_may_reach("x", "y", threshold)).select("a", "b")

    def with_sets(nodes: DataFrame) -> DataFrame:
        """node, size, bit sketch and elements of the nodes, from each text's first document."""
        firsts = texts.select("node", F.col("first_doc").alias("doc_id"), "s0", "s1", "s2", "size").join(nodes, "node", "left_semi")
        return signed.select("node", "doc_id", "elements").join(firsts, ["node", "doc_id"]).groupBy("node").agg(*(F.first(c).alias(c) for c in ("s0", "s1", "s2", "size", "elements")))

    hot = shared.filter(F.col("n") > LARGE)
    held = _homes(hot)
    x, y = (shared.filter(F.col("n") <= LARGE).join(held, "node", "left").alias(side) for side in "xy")
    apart = F.coalesce(F.arrays_overlap("x.large", "y.large"), F.lit(False))  # such pairs are compared in their large bucket
    small = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & ~apart)
    pairs = materialize(possible(small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()), "pairs")
    sets = materialize(with_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()).select("node", "elements"), "sets")
    full = pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "_x"}), "a").join(sets.withColumnsRenamed({"node": "b", "elements": "_y"}), "b")
    links = materialize(full.filter(_overlaps(F.col("_x"), F.col("_y"), threshold)).select("a", "b"), "links")
    release(spark, sets, pairs)
    edges, counts = links, links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    if not hot.isEmpty():
        sets = materialize(with_sets(held.select("node")).select("node", "elements").join(held, "node"), "sets")
        parts = materialize(_compare_large(_dealt(hot, held), sets, threshold), "parts")
        edges = links.unionByName(parts.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = counts.unionByName(parts.select("node", "n"))
        release(spark, sets)
    found = connected_components(edges)
    degree = counts.groupBy("node").agg(F.sum("n").alias("n_links"))
    classed = texts.select("node", "first_doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classed.groupBy("component").agg(F.min(F.struct("first_doc", "node")).alias("_least"))
    leads = ((F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("_lead"))).alias("leads")
    classed = classed.join(least, "component").join(degree, "node", "left").select("node", F.col("_least.first_doc").alias("class_id"), F.col("_least.node").alias("_lead"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classed = materialize(classed, "classes")
    ids = [F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("doc_id", "class_id")]
    out = materialize(signed.select("doc_id", "node").join(classed, "node").select(*ids, "n_links", F.col("node").alias("text_hash"), leads), "near-duplicates")
    release(spark, signed, texts, shared, links, found, classed, *([parts] if parts else []))
    return out
