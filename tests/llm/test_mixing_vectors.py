"""Mixing, whitening and vector codes against brute force, on edge rows and on empty tables."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.llm import mixing, queries, vector_codes, whitening

from .conftest import SCHEMA, prose

# --- 11 -------------------------------------------------------------------

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(sizes, weights):
    """Targets by handing out the excess again and again."""
    left, out = Fraction(3, 2) * sum(sizes), [Fraction(0)] * len(sizes)
    while left:
        free = [i for i in range(len(sizes)) if out[i] < 2 * sizes[i]]
        total = sum(weights[i] for i in free)
        for i in free:
            out[i] += left * weights[i] / total
        left = sum(max(Fraction(0), out[i] - 2 * sizes[i]) for i in free)
        out = [min(v, Fraction(2 * z)) for v, z in zip(out, sizes)]
    return out


def test_targets():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 100, 10_000]) * r.randint(0, 3) for _ in range(r.randint(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights, Fraction(3, 2), 2)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(g <= 2 * z for g, z in zip(got, sizes))
        assert all(abs(float(a - b)) < 1e-6 for a, b in zip(got, by_hand(sizes, weights)))
    assert mixing.targets([], [], Fraction(3, 2), 2) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1001])
def test_permutation(n):
    seeds = np.full(n, 77, np.uint64)
    assert sorted(mixing.permuted(np.arange(n), np.full(n, n), seeds).tolist()) == list(range(n))
    firsts = [int(mixing.permuted(np.array([0]), np.array([n]), np.array([s], np.uint64))[0]) for s in range(400)]
    assert n < 17 or n > 300 or len(set(firsts)) > 0.5 * min(n, 400) and abs(np.mean(firsts) - n / 2) < n / 5


def test_draws_give_the_words_asked_for():
    for size in (1, 7, 8, 9, 40, 63):
        for block in (1, 3, 8, 100):
            n = -(-size // block)
            order = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))
            lengths = [0] * n
            for b, at in enumerate(order):
                lengths[at] = min(block, size - b * block)
            for words in range(2 * size + 1):
                q, last = mixing.draws_for(words, size, block, 5)
                taken = (lengths * 3)[:q]
                assert sum(taken[:-1]) + last == words and (not q or 1 <= last <= taken[-1])


def test_split_has_exact_margins_and_spreads_like_a_shuffle():
    quotas = np.array([50, 0, 7, 300])
    found = np.array([mixing.split(quotas, 7, seed) for seed in range(300)])
    assert (found.sum(2) == quotas).all() and (found >= 0).all() and set(np.unique(found.sum(1))) <= {51}
    expected = quotas / 7
    assert (np.abs(found.mean(0) - expected[:, None]) < 0.15 * expected[:, None] + 0.2).all()
    p = 1 / 7
    variance = quotas * p * (1 - quotas / 357) * (1 - p) * 357 / 356  # hypergeometric
    assert np.allclose(found.var(0).mean(1), variance, rtol=0.15, atol=0.05)


def mixed_docs(spark):
    r = random.Random(3)
    rows = [(i, "  ".join(prose(i, r.choice([1, 5, 60, 300])).split()) + r.choice(["", "\n"]), "en", r.choice(["a", "b", "B", "é", "hot", "hot", "hot", None]), 1, 0.5, 1, 7, 9, 3) for i in range(150)]
    rows += [(1000, prose(9, 30_000), "en", "long", 1, 0.5, 1, 7, 9, 3), (1001, None, "en", "a", 0, 0.5, 1, 7, 9, 3), (1002, "", "en", "zero", 0, 0.5, 1, 7, 9, 3), (None, "x y z", "en", "a", 0, 0.5, 1, 7, 9, 3), (1003, "\xa0 　\x1c", "en", None, 3, 0.5, 1, 7, 9, 3)]
    rows += [(1004, "same row twice or more", "en", "b", 1, 0.5, 1, 7, 9, 3)] * 40
    return spark.createDataFrame(rows, SCHEMA)


def test_mix(spark):
    docs = mixed_docs(spark)
    mixed = mixing.mix(docs, block_words=64, shard_blocks=32)
    rows, spans = mixing.taken(mixed).collect(), mixed.spans.collect()
    texts = {(r.doc_id, r.source): r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(SPACE.findall(texts[r.doc_id, r.source])) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], Fraction(3, 2), 2)))
    for s in order:
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(goals[s])) for r in rows if r.source == s)
        assert sum(r.taken for r in rows if r.source == s) == int(goals[s] + Fraction(1, 2))
    words, places, ends = defaultdict(list), defaultdict(list), defaultdict(set)
    for s in spans:
        words[s.doc_id, s.source, s._part, s._nth, s.again] += range(s.first_word, s.first_word + s.n_words)
        places[s.shard].append(s.place)
        ends[s.shard].add(s.source)
    assert all(len(w) == len(set(w)) for w in words.values())  # no word twice in one round of draws
    assert len(places) > 5 and all(sorted(p) == list(range(len(p))) for p in places.values()) and sum(len(e) > 2 for e in ends.values()) > 3
    for s in mixing.with_texts(mixed.spans, docs).collect():
        own = list(SPACE.finditer(texts[s.doc_id, s.source]))
        end = own[s.first_word + s.n_words].start() if s.first_word + s.n_words < len(own) else None
        assert s.text == texts[s.doc_id, s.source][own[s.first_word].start() : end]


def test_mix_reruns_agree(spark):
    docs = mixed_docs(spark)
    names = ["shard", "place", "doc_id", "source", "first_word", "n_words", "again"]
    a, b = (sorted(map(str, mixing.mix(d, block_words=64, shard_blocks=32).spans.select(*names).collect())) for d in (docs, docs.repartition(7, "text")))
    assert a == b
    c = sorted(map(str, mixing.mix(docs, block_words=64, shard_blocks=32, seed=2).spans.select(*names).collect()))
    assert a != c


def test_mix_edges(spark, edge_docs, empty_docs):
    assert mixing.taken(mixing.mix(empty_docs)).collect() == []
    rows = mixing.taken(mixing.mix(edge_docs)).collect()
    size = sum(r.size for r in rows)
    assert len(rows) == edge_docs.count() and all(r.source_size == size and r.target == 1.5 * size and r.size <= r.taken <= 2 * r.size for r in rows)
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(mixing.mix(blank)).collect()] == [(0, 0.0, 0)] * 2


# --- 12 and 13 ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v int, _id string, _label int, part int"


def vector_rows(n, dims, seed=0, copies=True):
    r = np.random.default_rng(seed)
    spread = r.normal(size=(dims, dims)) / dims
    vectors = (r.normal(size=(n, dims)) @ spread + 0.3).astype(np.float32)
    if copies:
        vectors[n // 3 : 2 * n // 3] = vectors[min(5, n - 1)]  # a third are copies of one vector
    rows = [(i * 3, v.tolist(), (None, 1, 2, 3)[i % 4] if i % 2 else 1, 1, "x", 2, 3) for i, v in enumerate(vectors)]
    bad = [None, [None] + [0.1] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [float("-inf")] * dims]
    return rows + [(10**6 + i, v, 1, 1, "x", 2, 3) for i, v in enumerate(bad)]


def integers(row, dims):
    return [math.floor(64 * c) + 1_000_000 for c in row[1] + [0.0] * (dims - len(row[1]))]


def hold_whitening(spark, rows, dims, components=32):
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    model = whitening.fit(df)
    got = whitening.whiten(df, model, components).collect()
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    kept = [(r[0], [float(np.float32(c)) for c in r[1]]) for r in kept]
    x = [integers(r, dims) for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums)] for row in x])
    covariance = exact.T @ exact / n
    assert model.n == n and model.sums == sums and np.allclose(model.axes.T @ model.axes, np.eye(dims), atol=1e-12)
    scale = max(1e-300, np.abs(covariance).max())
    assert np.allclose(model.axes @ np.diag(model.values) @ model.axes.T, covariance, atol=1e-11 * scale) and (np.diff(model.values) <= 0).all()
    deviation = {}
    for r, row in zip(kept, x):
        deviation.setdefault(r[0], []).append(sum((n * v - s) ** 2 for v, s in zip(row, sums)))
    assert len(got) == n * min(dims, components)
    for r in got:
        assert r.n == n and (int(r.deviation) in deviation[r.vec_id] if r.deviation is not None else max(deviation[r.vec_id]) >= 10**38)
        assert r.explained == pytest.approx(model.values[r.component - 1] / (np.trace(covariance) or 1), rel=1e-9)
    return df, model, got, kept, exact


def test_whitening(spark):
    dims = 40
    df, model, got, kept, exact = hold_whitening(spark, vector_rows(300, dims), dims)
    assert whitening.identity_error(df, model) < 1e-9
    at = {r[0]: y for r, y in zip(kept, exact)}
    for r in got:
        k = r.component - 1
        assert r.whitened == pytest.approx(at[r.vec_id] @ model.axes[:, k] / math.sqrt(model.values[k]), rel=1e-9, abs=1e-9)
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 32)
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9


def test_whitening_edges(spark):
    rows = vector_rows(20, 4, copies=False)
    assert whitening.fit(spark.createDataFrame([], VECTORS)) is None and whitening.whiten(spark.createDataFrame([], VECTORS), None).collect() == []
    assert whitening.fit(spark.createDataFrame(rows[20:], VECTORS)) is None
    odd = rows + [(None, [0.5, 0.1, 0.2, 0.3], 1, 1, "x", 2, 3), (3, rows[1][1], 1, 1, "x", 2, 3), (5, [0.25], 1, 1, "x", 2, 3), (6, [], 1, 1, "x", 2, 3)]
    df, model, got, _, _ = hold_whitening(spark, odd, 4)
    assert whitening.identity_error(df, model) < 1e-9
    constant = [(i, [0.5, float(i % 3), 2.0], 1, 1, "x", 2, 3) for i in range(9)]
    df, model, got, _, _ = hold_whitening(spark, constant, 3)
    assert {r.component for r in got if r.whitened is None} == {2, 3} and whitening.identity_error(df, model) < 1e-12
    df, model, got, _, _ = hold_whitening(spark, constant[:1], 3)
    assert all(r.whitened is None for r in got) and whitening.identity_error(df, model) is None
    huge = [(i, [1e15 * i, -1e14 * i * i, 2.0], 1, 1, "x", 2, 3) for i in range(5)]
    hold_whitening(spark, huge, 3)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = -(-max(len(r[1]) for r in kept) // parts) * parts
    x = [[math.floor(1024 * float(np.float32(c))) for c in r[1]] + [0] * (dims - len(r[1])) for r in kept]
    w = dims // parts
    cut = [[row[p * w : (p + 1) * w] for row in x] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in own] for own, book in zip(cut, books)]

    for _ in range(rounds):
        new = []
        for own, book, found in zip(cut, books, assign()):
            members = defaultdict(list)
            for v, (_, k) in zip(own, found):
                members[k].append(v)
            new.append([[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(book)])
        books = new
    found = assign()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{found[p][i][1]:02x}" for p in range(parts)), sum(found[p][i][0] for p in range(parts)), r[2]) for i, r in enumerate(kept)]
    total = defaultdict(int)
    for _, _, e, label in out:
        total[label] += e
    return sorted([(i, c, e, total[label], sha) for i, c, e, label in out], key=str)


def codes(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted([(r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in vector_codes.encode(df, vector_codes.fit(df)).collect()], key=str)


@pytest.mark.parametrize("n,dims", [(400, 8), (330, 12), (40, 6), (3, 4)])
def test_codes(spark, n, dims):
    """Copies among the first vectors make equal entries, coarse values make equal distances."""
    rows = [(r[0], [round(c * 8) / 8 for c in r[1]] if r[1] and i < 2 * n // 3 and r[1][0] is not None else r[1], *r[2:]) for i, r in enumerate(vector_rows(n, dims))]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.fit(empty) is None and vector_codes.encode(empty, None).collect() == []
    assert vector_codes.fit(spark.createDataFrame(vector_rows(9, 4)[9:], VECTORS)) is None
    rows = vector_rows(30, 4, copies=False) + [(None, [0.5, 0.1, 0.2, 0.3], None, 1, "x", 2, 3), (3, [0.75] * 4, 1, 1, "x", 2, 3), (5, [0.25], 1, 1, "x", 2, 3), (6, [], 1, 1, "x", 2, 3), (7, [2.0**20, -(2.0**21), 3.0, 4.0], 1, 1, "x", 2, 3)]
    assert codes(spark, rows) == brute_codes(rows)
    huge = rows + [(8, [2.0**70, 2.0**60, 3.0, 4.0], 1, 1, "x", 2, 3), (1, [2.0**60, 2.0**61, 3.0, 4.0], 1, 1, "x", 2, 3)]
    df = spark.createDataFrame(huge, VECTORS)
    model = vector_codes.fit(df)
    assert [r[-1] for r in brute_codes(huge)][0] == model.sha256()


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_nearest_entry(kind):
    r = np.random.default_rng(4)
    entries = r.integers(-3, 4, (200, 5))
    entries[50:60] = entries[7]
    parts = np.vstack([r.integers(-4, 5, (300, 5)), entries])
    index, d = vector_codes.nearest(vector_codes.build(entries.astype(kind)), parts.astype(kind))
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (d.astype(np.int64) == every.min(1)).all()


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    mixed_docs(spark).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vector_rows(120, 40), VECTORS).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_queries(spark, small_tables):
    got = queries.op11_mixing(spark, small_tables)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")] and got.count() == 195
    sums = got.groupBy("target").agg(F.sum("taken").alias("t"), F.countDistinct("source_size").alias("n")).collect()
    assert sum(r.t for r in sums) == pytest.approx(1.5 * got.agg(F.sum("size")).first()[0], abs=len(sums))
    got = queries.op12_whitening(spark, small_tables)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert got.count() == 120 * 32 and got.filter("identity_error > 1e-6 or deviation is null or whitened is null").count() == 0
    rows = vector_rows(120, 40)
    got = queries.op13_vector_codes(spark, small_tables)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)
