"""Every operator against brute force or a round trip, on edge rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoalwork.llm import bagminhash, fingerprints, hamming, language, licenses, packing, piece_codec, quality, suffix_dedup, token_codec
from shoalwork.llm._common import WordCache, text_runs
from shoalwork.llm.queries import tokenizer_path

from .conftest import SCHEMA, prose, rows_of

BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- tokenizer cache ------------------------------------------------------

@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_word_cache_equals_whole_encoding(path, spaced):
    r, cache = random.Random(5), WordCache(path, spaced, limit=500)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "\xa0", "\0", "\x1c", "'s", "9", ".", "é", "́", "ß", "Σ", "<|endoftext|>", "日", "\r"]
    for _ in range(60):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(20)]
        for text, got, want in zip(texts, cache.encode(texts), cache.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert got == np.array(want.ids, "<u4").tobytes(), text


# --- 1 --------------------------------------------------------------------

def test_license_base_equals_brute_force(spark):
    texts = ["Under the MIT-License, under the mit license.", "x apache  LICENSE, version 2.0 cc by-nc", "Cc By Nc cc by nc", "mit license", "", None, "ünder the mit license", "aunder the mit license b",
             "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        places = [(k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), text
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
    assert got[8].labels == "cc-by-nc,gpl" and got[9].labels == "mit" and got[9].base_labels == ""


def test_license_windows_of_many_templates(spark, capsys):
    """300 templates against brute force over all windows of all texts; candidates come by their words, so no plan holds all against all."""
    r = random.Random(12)
    known = [f"w{i}" for i in range(400)]
    templates = tuple((" ".join(r.choice(known) for _ in range(r.randint(3, 14))), f"label{k % 40}") for k in range(300))
    texts = []
    for k in range(60):
        words = [r.choice(known) for _ in range(r.choice([0, 3, 40, 200]))]
        for _ in range(r.randint(0, 3)):
            held = r.choice(templates)[0].split()
            if r.random() < 0.6 and len(held) > 10:
                held[r.randrange(len(held))] = "changed"
            if r.random() < 0.3:
                held.insert(r.randrange(len(held)), "put-in" if r.random() < 0.5 else "in")
            at = r.randint(0, len(words))
            words[at:at] = held
        texts.append(r.choice([" ", "\n", ".\n"]).join(words))
    df = spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)
    got = licenses.scan(df, templates, (("not there", "none"),), 0.9)
    found = {x.doc_id: (x.labels, x.score) for x in got.collect()}
    index = licenses.template_index(templates, 0.9, {})
    want = {}
    for i, text in enumerate(texts):
        words, labels, best = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), set(), 0.0
        blocks = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)) for b in re.split(r"\n|[.!?]+(?=\s|$)", text.lower())]
        for t in index:
            own = set(t["words"])
            n = max([len(own & b) for b in blocks] + [len(own & set(words[p : p + t["span"]])) for p in range(max(1, len(words) - t["span"] + 1))])
            if n >= t["least"]:
                labels.add(t["label"])
                best = max(best, n / len(own))
        want[i] = (",".join(sorted(labels)), best)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()} and all(found[k][1] == pytest.approx(want[k][1]) for k in want)
    assert sum(bool(v[0]) for v in want.values()) > 20
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_license_edges(edge_docs, empty_docs, spark):
    rows = licenses.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.labels == "" and r.score == 0 for r in rows)
    odd = spark.createDataFrame(rows_of([(None, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0.")]), SCHEMA)
    assert sorted((r.doc_id or 0, r.labels) for r in licenses.scan(odd).collect()) == [(0, "cc-by-nc"), (0, "mit"), (1, "cc-by-nc"), (1, "cc-by-nc")]
    assert licenses.scan(empty_docs).count() == 0


def test_license_notices_as_published(spark):
    """Wrapped lines, comment signs and abbreviations do not part a notice; words far apart make none."""
    notices = [
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
        ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or"),
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
        ("apache-2", "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0"),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ]
    filler = prose(5, 300)
    docs = [n for _, n in notices] + [f"{filler}\n{n}\n{filler}" for _, n in notices] + [" filler\n".join(n.split()) for _, n in notices]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows_of(list(enumerate(docs))), SCHEMA)).collect()}
    assert [got[i] for i in range(len(docs))] == [label for label, _ in notices] * 2 + [""] * len(notices)


def test_license_join_equals_all_pairs(spark):
    """Prefix, length and position filters lose no block that reaches the threshold."""
    r = random.Random(2)
    templates = tuple((" ".join(r.sample("a b c d e f g h i j k l m n o p".split(), r.randint(4, 9))), f"t{i}") for i in range(12))
    docs = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 25)))) for i in range(150)]
    got = {x.doc_id: x.labels for x in licenses.scan(spark.createDataFrame(rows_of(docs), SCHEMA), templates, (("zz yy", "z"),), 0.7).collect()}
    for i, text in docs:
        want = {label for t, label in templates if len(set(t.split()) & set(text.split())) >= math.ceil(0.7 * len(set(t.split())) - 1e-9)}
        assert got[i] == ",".join(sorted(want))


# --- 2 --------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 255, 257, 3000, 40_000])
def test_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50257).astype("<u4")
    block = token_codec.encode_block([(3, ids[: n // 2].tobytes()), (8, ids[n // 2 :].tobytes())], 50257, 7)
    docs, sizes, back, before = token_codec.decode_block(block)
    assert (back == ids).all() and list(docs) == [3, 8] and list(sizes) == [n // 2, n - n // 2] and before == 7


def test_any_damage_is_told():
    ids = np.arange(20, dtype="<u4")
    block = token_codec.encode_block([(3, ids[:9].tobytes()), (8, ids[9:].tobytes())], 64)
    for bit in range(8 * len(block)):
        bad = bytearray(block)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises(ValueError):
            token_codec.decode_block(bytes(bad))
    for n in range(len(block)):
        with pytest.raises(ValueError):
            token_codec.decode_block(block[:n])


def test_mixture_is_one_distribution():
    """The intervals of all ids, one after another, fill the range, and each value is found in its own."""
    mixer, rng = token_codec.Mixer(6, 3, True), np.random.default_rng(1)
    last1 = last2 = np.zeros(3, np.int64)
    for _ in range(40):
        mixer.predict(last1, last2)
        end = np.zeros(3, np.int64)
        for i in range(6):
            start, size = mixer.interval(np.full(3, i, np.int32))
            assert (start == end).all() and (size > 0).all()
            end = end + size
            for value in (start, start + size - 1):
                assert (mixer.find(value.astype(np.int32)) == i).all()
        assert (end <= 1 << int(token_codec.TOTAL)).all()
        x = rng.integers(0, 6, 3).astype(np.int32)
        mixer.interval(x)
        mixer.learn(x)
        last1, last2 = x.astype(np.int64), last1


def test_blocks_shrink_repetitive_ids():
    ids = np.tile(np.arange(40, dtype="<u4"), 2000)
    assert len(token_codec.encode_block([(0, ids.tobytes())], 50257)) < len(ids)


def test_token_files(spark, edge_docs, tmp_path):
    token_codec.write_tokens(edge_docs, BYTE, str(tmp_path / "t"), block_ids=500)
    got = token_codec.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    cache = WordCache(BYTE, True)
    want, start = [], 0
    rows = edge_docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    for doc, text, _ in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text)):
        ids = cache.tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    manifest = spark.read.parquet(str(tmp_path / "t" / "manifest")).collect()
    assert sum(r.n_tokens for r in manifest) == start and sum(r.n_docs for r in manifest) == len(want)


def test_no_tokens(spark, tmp_path):
    token_codec.write_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE, str(tmp_path / "t"))
    assert token_codec.read_tokens(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("path, keep", [(BYTE, True), (WORD, False)])
def test_word_cache_equals_the_library(path, keep):
    """Words come and go from a cache that is far too small; white space and marks of all kinds."""
    cache, r = WordCache(path, keep, 30), random.Random(8)
    parts = ["a", "The", "İstanbul", "ing", " ", " ", "\n", "\t", "é", "e\u0301", "日本", "  ", ".", ",", "!?", "'s", "\x01", "\0", "\u00a0", "\x1c", "12", "7", "<|endoftext|>", "\u2028", "ǅ", "Σ"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(12)]
        for text, ids in zip(texts, cache.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path, keep", [(BYTE, True), (WORD, False)])
def test_words_with_marks_reach_the_library_as_stems(path, keep, monkeypatch):
    """Whatever marks follow the letters, the stem is encoded once, and texts are those of the library."""
    cache, sent = WordCache(path, keep), []
    learn_lines, learn_alone = cache.learn_lines, cache.learn_alone
    monkeypatch.setattr(cache, "learn_lines", lambda lines, *more: (sent.extend(w for line in lines for w in line), learn_lines(lines, *more)))
    monkeypatch.setattr(cache, "learn_alone", lambda words: (sent.extend(words), learn_alone(words)))
    texts = [f"a {stem}{tail} b\n{stem}{tail} {stem}'s{tail}" for stem in ("ertiat", "Éinß", "it's", "日本") for tail in ("", "***", "!!", ".&&&", "'", "|>", "_-", ";")]
    for text, ids in zip(texts, cache.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(sent) == len(set(sent)) and not [w for w in sent if w[-1] in "*!.&'|>_-;" and any(c.isalpha() for c in w)]


def test_runs_of_texts_cross_batches():
    """Rows come whole and in order, many batches to a run, and a run ends with the text that fills it."""
    texts = ["x" * (i % 7) for i in range(50)]
    rows = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 3, 50))), pa.array(texts[i : i + 3])], names=["doc_id", "text"]) for i in range(0, 50, 3)]
    runs = list(text_runs(iter(rows), 40))
    assert [x for ids, _ in runs for x in ids] == list(range(50)) and [t for _, run in runs for t in run] == texts
    assert all(40 <= sum(map(len, run)) < 47 for _, run in runs[:-1]) and list(text_runs(iter([]))) == []


def test_line_ends_and_copies_in_one_run():
    """Texts that end or begin with line ends or are empty stand beside others; only their own white space counts."""
    cache, r = WordCache(BYTE, True), random.Random(2)
    texts = ["", "a\n", "\nb", "", "\n\nc d", " e ", "f\n\n", "g  h", "", "i\u00a0j", "k l", "k l", "\n", " ", "m\0n o", "p\r\nq", ""]
    for _ in range(20):
        for text, ids in zip(texts, cache.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text
        r.shuffle(texts)
    assert cache.encode([]) == [] and cache.encode([""]) == [b""]


# --- 3 --------------------------------------------------------------------

def test_long_texts_stream_in_parts(monkeypatch):
    """Texts many parts long, with words and runs of spaces longer than a part; what is held stays small."""
    own, r, held = piece_codec.PieceCodec(PIECE), random.Random(5), []
    monkeypatch.setattr(piece_codec, "PART", 50)
    monkeypatch.setattr(piece_codec, "LONG", 20)
    feed = piece_codec.Search.feed

    def watched(self, chars):
        for ids in feed(self, chars):
            held.append(len(self.chars))
            yield ids

    monkeypatch.setattr(piece_codec.Search, "feed", watched)
    alphabet = ["a", "the", "ing" * 20, " ", " " * 70, "\n", "é日", "lorem" * 40, ". ", "x" * 119, "▁"]
    for _ in range(150):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.model.encode(text), text
    assert max(held) < 300


def test_pieces_equal_the_library():
    own, r = piece_codec.PieceCodec(PIECE), random.Random(4)
    alphabet = ["a", "th", "ing", " ", " ", "\n", "é", "日", "の", "ion", "  ", ".", "\U0001f600", "▁", "\0", "zq"]
    for _ in range(600):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == own.model.encode(text), text
        assert own.decode(np.array(ids, "<u4").tobytes()) == own.model.decode(ids)


def test_stream_commits_early_and_keeps_context():
    own = piece_codec.PieceCodec(PIECE)
    text = "▁" + prose(6, 4000).replace(" ", "")
    parts = list(own.stream(text))
    assert len(parts) > 20 and [i for p in parts for i in p] == own.model.encode(text[1:])


def test_unigram_lattice_equals_full_search():
    own, r = piece_codec.PieceCodec(PIECE), random.Random(9)
    own.kind, own.units = piece_codec.UNIGRAM, False
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca"]
    own.ids, own.scores, own.longest, own.penalty, own.bytes, own.unknown = {p: i for i, p in enumerate(pieces)}, [-r.uniform(1, 9) for _ in pieces], 3, -30.0, {}, 99
    for _ in range(60):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 40)))
        best = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - 3), end):
                i = own.ids.get(text[start:end])
                if i is not None or end - start == 1:
                    options.append((best[start][0] + (own.penalty if i is None else own.scores[i]), best[start][1] + [99 if i is None else i]))
            best[end] = max(options, key=lambda o: o[0])
        assert [i for p in own.stream(text) for i in p] == best[-1][1]


def test_piece_query_on_edge_rows(edge_docs):
    rows = piece_codec.encode_documents(edge_docs, PIECE).collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip for r in rows)
    back = piece_codec.decode_ids(piece_codec.encode_ids(edge_docs, PIECE), PIECE)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((d or -1, t) for d, t in texts_of(edge_docs))


# --- 4 --------------------------------------------------------------------

def brute_repeats(texts, length):
    data = [t.encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    for b in data:
        spans = suffix_dedup.covered([(p, p) for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1], length)
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        yield len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()


def check_repeats(spark, docs, length):
    texts = [(d, t) for d, t in texts_of(docs)]
    want = Counter((d, *r) for (d, _), r in zip(texts, brute_repeats([t for _, t in texts], length)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, length).collect())
    assert got == want


def test_repeats_on_edge_rows(spark, edge_docs):
    check_repeats(spark, edge_docs, 200)


@pytest.mark.parametrize("length", [5, 20, 64, 200])
def test_repeats_equal_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    r = random.Random(length)
    parts = [prose(i, 60) for i in range(6)] + ["ab" * 300, "x" * 500, "é" * 150]
    docs = [(i, "".join(r.choice(parts)[r.randrange(50) :] if r.random() < 0.6 else prose(100 + i, 30) for _ in range(r.randrange(6)))) for i in range(25)]
    check_repeats(spark, spark.createDataFrame(rows_of(docs), SCHEMA), length)


def test_without_repeats_keeps_columns(spark):
    docs = spark.createDataFrame(rows_of([(1, "é" * 150 + "tail one"), (2, "é" * 150 + "another"), (3, None)]), SCHEMA)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "tail one", 2: "another", 3: None}


# --- 5 and 6 --------------------------------------------------------------

def language_rows(n):
    words = {"en": "the of and that with this have from", "de": "der die und nicht mit sich auch über", "fr": "le la les des être avec pour où", "es": "el los que del por una más año"}
    r = random.Random(3)
    return [(i, " ".join(r.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(r.choice(list(words)) for _ in range(n))]


def test_language_held_out_accuracy(spark):
    rows = language_rows(400)
    docs = spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == g for i, g in held) / len(held) > 0.97


def test_language_edges(spark, edge_docs, empty_docs):
    out = language.predict(edge_docs, language.train(edge_docs)).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.lang_score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in language.predict(edge_docs, language.train(empty_docs)).collect()} == {"und"}
    assert language.predict(empty_docs, language.train(empty_docs)).count() == 0


def test_language_never_learns_from_held_out(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in language_rows(100)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "xx" not in model.names


def quality_tables(spark, n=600):
    r, docs, labels = random.Random(8), [], []
    for i in range(n):
        bad = r.random() < 0.25
        text = prose(i, r.randint(30, 90))
        if bad:
            text = r.choice([lambda t: "!! ".join(t.upper().split()), lambda t: " | ".join(t.split()), lambda t: "$$$ ".join(t.split()), lambda t: " ".join([t.split()[0]] * 80)])(text)
        docs.append((i, text))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_held_out_accuracy(spark):
    docs, labels = quality_tables(spark)
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(quality.fold(F.col("doc_id"), 5) == 0)
    assert got.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (6, 0), (7, 2)], "doc_id long, quality int")
    for labels in (none, odd):
        out = quality.score(edge_docs, quality.train(edge_docs, labels))
        assert out.count() == edge_docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(empty_docs, quality.train(empty_docs, none)).count() == 0


def test_rules_compile_to_what_they_say(spark):
    model = quality.Model(0.5, (quality.Rule((("words", True, 3.0),), -2.0), quality.Rule((("words", False, 3.0), ("upper", False, 0.5)), 1.5)))
    docs = spark.createDataFrame(rows_of([(0, "a b"), (1, "A B C D E"), (2, "a b c d e")]), SCHEMA)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    assert got[0] == pytest.approx(sigmoid(-1.5)) and got[1] == pytest.approx(sigmoid(2.0 if 5 / 9 > 0.5 else 0.5)) and got[2] == pytest.approx(sigmoid(0.5))


# --- 7 --------------------------------------------------------------------

def sequences_of(patterns):
    return [sum(([length] * copies for length, copies in runs), []) for runs, count in patterns for _ in range(count)]


def test_spfhp_uses_every_length_once():
    r = random.Random(1)
    for _ in range(60):
        histogram = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 30))}
        sequences = sequences_of(packing.spfhp(histogram, 64))
        assert Counter(length for s in sequences for length in s) == histogram and all(sum(s) <= 64 for s in sequences)
        least = sorted(map(sum, sequences))[:2]
        assert len(least) < 2 or sum(least) > 64  # no two fit in one


@pytest.mark.parametrize("histogram,most", [({1000: 3000}, 750), ({2000: 50, 1000: 10}, 28), ({500: 10_000}, 1250), ({1: 5000}, 2), ({4096: 3, 1: 1}, 4), ({1366: 10}, 5), ({3000: 4, 1000: 9}, 6)])
def test_spfhp_fills_sequences_of_few_lengths(histogram, most):
    patterns = packing.spfhp(histogram, 4096)
    sequences = sequences_of(patterns)
    assert len(sequences) == most and Counter(length for s in sequences for length in s) == histogram and sum(len(runs) for runs, _ in patterns) <= 8


def test_packing_documents_of_one_length(spark):
    got = packing.pack(spark.range(3001).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length")))
    places = got.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect()
    assert sorted(r.sequence_id for r in places) == list(range(751)) and sorted(r.o for r in places) == [[0]] + [[0, 1000, 2000, 3000]] * 750


def test_packing_places_every_token(spark, edge_docs):
    rows = packing.pack_documents(edge_docs, WORD, max_len=256).collect()
    tokenizer = WordCache(WORD, False).tokenizer
    want = Counter()
    for doc, text in texts_of(edge_docs):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), 256):
            want[doc, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(i % 3, 0, 5 + i % 4, i, 7, 8, 9) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, _rank int, _salt int, sequence_id int, offset int")
    got = packing.pack(df, 16).collect()
    assert sorted((r.doc_id, r.length, r._rank) for r in got) == sorted((r[0], r[2], r[3]) for r in rows) and {r._salt for r in got} == {7}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 16


def test_packing_empty(empty_docs):
    assert packing.pack_documents(empty_docs, WORD).count() == 0


# --- 8 --------------------------------------------------------------------

def shingle_set(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fingerprints_equal_brute_force(spark):
    docs = [(i * 3, prose(i, random.Random(i).choice([0, 1, 4, 5, 60, 400]))) for i in range(40)] + [(500, prose(2, 60)), (10**9, "é" * 10), (10**9 + 1, "")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()}
    order = sorted(docs, reverse=True)
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingle_set(text), shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) <= (0.12 if len(a | b) > 256 else 1e-9)


def test_next_documents(spark):
    """An outlying id, an id on many texts, ids that are null: each row once, and the next one in order."""
    docs = [(i, f"t{i}") for i in range(400)] + [(2**60, "far"), (-(2**63), "least")] + [(77, f"u{i}") for i in range(300)] + [(None, f"n{i}") for i in range(60)] + [(5, "same")] * 40
    rows = spark.createDataFrame(rows_of(docs), SCHEMA)
    pairs = fingerprints.with_next(rows, lambda x: x, rows_each=20).select("doc_id", "text", "next_text").collect()
    hashed = rows.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = [(r.doc_id, r.text, order[(k + 1) % len(order)].text) for k, r in enumerate(order)]
    assert sorted(map(str, map(tuple, pairs))) == sorted(map(str, want))


def test_sketch_is_the_least_hashes(spark):
    """The sketch against all shingle hashes of a text, one by one."""
    for n in (0, 1, 4, 5, 70, 900):
        sketch = fingerprints.with_sketch(spark.createDataFrame([(prose(n, n),)], "text string"), "text", "s", 64).first().s
        words = re.findall(r"[^\W_]+", prose(n, n).lower())
        runs = [words[i : i + 5] for i in range(len(words) - 4)]
        if runs:
            hashes = spark.createDataFrame([(r,) for r in runs], "w array<string>").selectExpr("shiftrightunsigned(xxhash64(" + ", ".join(f"xxhash64(w[{j}])" for j in range(5)) + "), 32) AS h")
            assert sketch == sorted({r.h for r in hashes.collect()})[:64]
        else:
            assert len(sketch) == (1 if words else 0)


def test_fingerprint_edges(edge_docs, empty_docs):
    rows = fingerprints.edited_fingerprints(edge_docs).collect()
    assert len(rows) == edge_docs.count() and sum(r.doc_id is None for r in rows) == 2
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.fingerprint)
    assert by[0] == by[1] and by[2] == by[3] == {""}
    assert fingerprints.edited_fingerprints(empty_docs).count() == 0


def test_sketches_merge(spark):
    a, b = prose(1, 900), prose(2, 700)
    rows = spark.createDataFrame([(0, a), (0, b), (1, a)], "g int, text string")
    sketched = fingerprints.with_sketch(rows, "text", "sketch")
    merged = {r.g: r.sketch for r in fingerprints.merge_groups(sketched, ["g"], "sketch").collect()}
    own = [r.sketch for r in sketched.collect()]
    assert merged[0] == sorted(set(own[0]) | set(own[1]))[:256] and merged[1] == own[2]
    n = sketched.filter("g = 1").select(fingerprints.distinct_count(F.col("sketch"))).first()[0]
    assert abs(n / len(shingle_set(a)) - 1) < 0.2


# --- 9 --------------------------------------------------------------------

def bag(text):
    words = re.findall(r"\w+", text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else (Counter([tuple(words)]) if words else Counter())


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    ids = r.integers(0, 2**63, 300).astype(np.uint64)
    errors = []
    for _ in range(40):
        a, b = r.integers(0, 6, 300), r.integers(0, 6, 300)
        least = bagminhash.signatures([(ids[a > 0], a[a > 0]), (ids[b > 0], b[b > 0])], 512)
        errors.append((least[0] == least[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        ids = ids + np.uint64(1)
    assert abs(np.mean(errors)) < 0.012 and np.abs(errors).max() < 0.1


def near_docs():
    r, docs = random.Random(6), []
    for g in range(30):
        base = prose(g, r.choice([20, 60, 200])).split()
        for _ in range(r.randint(1, 7)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = f"w{r.randrange(999)}"
            docs.append((len(docs), " ".join(words)))
    return docs + [(900, ""), (901, None), (902, "..."), (903, "one two"), (904, "one  two"), (905, "w " * 50), (906, "w " * 55), (907, "w " * 30)]


def test_near_duplicate_classes_equal_brute_force(spark):
    docs = near_docs()
    bags = {i: bag(t or "") for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in docs:
        for j, u in docs:
            if i < j:
                both = sum((bags[i] & bags[j]).values())
                if (t or "") == (u or "") or (bags[i] and both >= 0.8 * sum((bags[i] | bags[j]).values()) - 1e-9):
                    parent[find(j)] = find(i)
    classes = defaultdict(list)
    for i in parent:
        classes[find(i)].append(i)
    want = {i: min(m) for m in classes.values() for i in m}
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()}
    assert got == want


@pytest.mark.parametrize("large,least,block_nodes", [(32, 512, 4096), (4, 2, 5), (2, 1, 1)])
def test_near_duplicate_links_equal_brute_force(spark, monkeypatch, large, least, block_nodes):
    """Groups of a dozen and of forty near-copies; large buckets whole, and dealt into many blocks."""
    monkeypatch.setattr(bagminhash, "LARGE", large)
    monkeypatch.setattr(bagminhash, "LEAST_BLOCK", least)
    monkeypatch.setattr(bagminhash, "BLOCK_NODES", block_nodes)
    r, docs = random.Random(8), near_docs()
    for g, copies, edits in ((50, 12, 1), (51, 40, 1), (52, 40, 4)):
        base = prose(g, 200).split()
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(1, edits)):
                words[r.randrange(len(words))] = f"w{r.randrange(9999)}"
            docs.append((len(docs) + 1000, " ".join(words)))
    bags = {t or "": bag(t or "") for _, t in docs}
    links = Counter()
    for t, x in bags.items():
        for u, y in bags.items():
            both = sum((x & y).values())
            links[t] += t != u and bool(x) and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) - 1e-9
    got = {row.doc_id: row.n_links for row in bagminhash.near_duplicates(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()}
    assert got == {i: links[t or ""] for i, t in docs} and max(got.values()) >= 30


@pytest.mark.parametrize("tile", [7, 1024])
@pytest.mark.parametrize("crossed", [False, True])
def test_links_of_a_part_in_tiles(monkeypatch, tile, crossed):
    """Links of one home in its bucket alone, others in the least bucket that they share, whatever the tiles."""
    monkeypatch.setattr(bagminhash, "TILE", tile)
    r = np.random.default_rng(6)
    n, base = 60, np.arange(100) * 7
    sets = [np.unique(np.concatenate((base[r.random(100) > 0.08], r.integers(1000, 2000, 4)))).astype(np.int32) for _ in range(n)]
    homes, large, block = r.choice([5, 9], n), [[5, 7, 9] if x else [7, 9] for x in r.random(n) > 0.5], r.choice([1, 1 << 30], n) if crossed else np.zeros(n, int)
    table = pa.table({"key": [9] * n, "low": [0] * n, "high": [int(crossed)] * n, "block": pa.array(block, pa.int32()), "node": pa.array(r.permutation(n) - 20, pa.int64()), "home": homes, "large": large,
                      "elements": pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))})
    got = {g["node"]: g for g in bagminhash._links_of_part(table, 0.8).to_pylist()}
    links, node = defaultdict(set), table["node"].to_pylist()
    for i in range(n):
        for j in range(n):
            own = homes[i] == 9 if homes[i] == homes[j] else not {5, 7} & set(large[i]) & set(large[j])
            if i != j and own and (not crossed or block[i] != block[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                links[node[i]].add(node[j])
    assert {k: g["n"] for k, g in got.items()} == {k: len(links[k]) for k in node} and sum(map(len, links.values())) > 50
    for k in node:
        reach, todo = {k}, [k]
        while todo:
            todo += [x for x in links[todo.pop()] - reach if not reach.add(x)]
        assert got[k]["root"] in reach and {got[x]["root"] for x in reach} == {got[k]["root"]}


def test_near_duplicate_rows_of_large_buckets(spark):
    """5,000 near copies: one class, every link counted, and few rows sent for each node of a bucket."""
    r, base = random.Random(4), prose(77, 200).split()
    docs = [(i, " ".join([*base[:k], f"w{i}", *base[k + 1 :]])) for i in range(5000) for k in [r.randrange(200)]]
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    signed = bagminhash.sign(df).select("node", "size", F.explode("bands").alias("key"))
    hot = signed.join(signed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bagminhash.LARGE), "key").cache()
    rows, dealt = hot.count(), bagminhash._dealt(hot, bagminhash._homes(hot)).count()
    assert rows > 50_000 and dealt < 4 * rows, (rows, dealt)
    hot.unpersist()
    assert bagminhash.near_duplicates(df).groupBy("class_id", "n_links").count().collect() == [(0, 4999, 5000)]


def test_near_duplicate_edges(edge_docs, empty_docs):
    docs = edge_docs
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(docs).collect())
    assert sum(got.values()) == docs.count() and got[1, 0] == 2 and got[3, 2] == 1 and got[None, 2] == 1 and got[None, None] == 1
    assert bagminhash.near_duplicates(empty_docs).count() == 0


# --- 10 -------------------------------------------------------------------

@pytest.mark.parametrize("dims,n,least_scan", [(64, 400, 4096), (8, 60, 4096), (70, 150, 4096), (64, 5, 4096), (64, 400, 0)])
def test_top_k_equals_brute_force(spark, monkeypatch, dims, n, least_scan):
    monkeypatch.setattr(hamming, "LEAST_SCAN", least_scan)
    monkeypatch.setattr(hamming, "BLOCK", 20)
    r = np.random.default_rng(dims + n)
    vectors = r.normal(size=(n, dims))
    vectors[n // 3 : 2 * n // 3] = vectors[0]  # a third are copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (n + 1, None), (None, rows[0][1]), (0, rows[0][1])], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for q in hamming.top_k(df, df.filter("vec_id % 7 = 0"), 10).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.distance, q.neighbor_id))
    bits = vectors.astype(np.float32) > 0
    for q in range(0, n, 7):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(n) if i != q)[:10]
        assert got[q] == want


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.top_k(df, df).count() == 0
