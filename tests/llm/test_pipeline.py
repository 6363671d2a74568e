"""The pipeline's stages on a small corpus, each held against brute force on its own input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shoalwork.llm._common import WordCache
from shoalwork.llm.queries import tokenizer_path

from .conftest import prose
from .test_operators import brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, docs, labels = random.Random(4), [], []
    passage = prose(77, 70)
    for i in range(240):
        text, bad = prose(i, 110 if i == 7 else r.randint(40, 120)), i % 6 == 0
        if bad:
            text = "!! ".join(text.upper().split())
        elif i % 10 == 1:
            text += "\n" + passage
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    base = docs[7][1].split()
    for k in range(5):
        words = list(base)
        words[k * 3] = f"edit{k}"
        docs.append((300 + k, " ".join(words), "en", "s", 9))
    docs += [(400, docs[8][1], "en", "s", 9), (401, None, None, None, None), (402, "", "en", "s", 0), (403, "12345 67890 " * 20, None, "s", 9)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, corpus, tmp_path_factory):
    out = [spark.read.parquet(f"{corpus}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], corpus).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def test_columns_stay(steps):
    for df in steps[1:5]:
        assert df.columns == COLUMNS


def test_quality_rejects_junk_and_keeps_clean(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    clean = {i for i in range(240) if i % 6}
    assert len(clean - kept) <= 2 and len(kept & {i for i in range(240) if i % 6 == 0}) <= 2


def test_language_drops_what_has_none(steps):
    before, after = ({r.doc_id for r in steps[k].collect()} for k in (1, 2))
    assert not after & {401, 402, 403} and before - after <= {401, 402, 403}


def test_language_drops_what_was_not_learnt(spark):
    """Other scripts, encoded data and random letters go; clean documents, held out of training or not, all stay."""
    r = random.Random(5)
    words = {lang: [w for w in prose(k, 400).replace(".", "").split()] for k, lang in enumerate(("en", "de", "es", "fr"))}
    docs = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(20, 150))), lang) for i, lang in enumerate(r.choices(list(words), k=400))]
    letters = {1000: "αβγδεζηθικλμνξοπρστυφχψω", 1001: "абвгдежзийклмнопрстуфхцчшщыьэюя", 1002: "abcdefghijklmnopqrstuvwxyz", 1003: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    docs += [(i, " ".join("".join(r.choice(a) for _ in range(64 if i == 1003 else r.randint(2, 9))) for _ in range(60)), None) for i, a in letters.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {x.doc_id for x in corpus_pipeline.language_stage(spark, df, "").collect()} == set(range(400))


def test_one_of_each_group_stays(steps):
    kept = {r.doc_id for r in steps[3].collect()}
    assert 7 in kept and not kept & {300, 301, 302, 303, 304, 400} and {r.doc_id for r in steps[2].collect()} - kept == {300, 301, 302, 303, 304, 400}


def test_repeats_go_byte_for_byte(steps):
    before, after = ({r.doc_id: r for r in steps[k].collect()} for k in (3, 4))
    assert set(before) == set(after)
    ids = sorted(before)
    for i, (_, removed, _, _) in zip(ids, brute_repeats([before[i].text or "" for i in ids], 200)):
        assert len((after[i].text or "").encode()) == len((before[i].text or "").encode()) - removed
        assert after[i].n_chars == len(after[i].text or "")
    assert any(before[i].text != after[i].text for i in ids)


def test_pack_holds_every_token(spark, corpus, steps):
    tokenizer = WordCache(tokenizer_path("word_bpe_49k.json"), False).tokenizer
    want = Counter()
    for r in steps[4].collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), 4096):
            want[r.doc_id, s, zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in steps[5].collect()) == want
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, corpus).collect()) == want


def test_extra_columns_and_repeated_ids(spark, tmp_path):
    """Columns of any name stay as they are; of two texts under one doc_id a near-duplicate goes."""
    base, other = prose(1, 90), prose(2, 90)
    docs = [(1, base), (1, base + " more"), (2, other), (3, base), (None, other + " end"), (None, prose(5, 60)), (7, None)]
    names = ["score", "_first", "_hash", "_own", "row", "lang_pred", "lang_score", "_uid", "_text", "_row", "_quality_words", "sequence_id", "_rank"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    df = spark.createDataFrame([(i, t, "en", "s", 5, *range(len(names))) for i, t in docs], schema)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect()), name
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert {i for i, _ in kept} == {1, 2, None, 7} and len(kept) == 4 and len({t for i, t in kept if i == 1}) == 1


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
