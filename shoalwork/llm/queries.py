"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, fingerprints, hamming, language, licenses, mixing, packing, piece_codec, quality, suffix_dedup, token_codec, vector_codes, whitening
from ._common import delete, materialize, read_table, release, table_path


REMEMBERED = 1_000_000  # words; a worker of op2 or op7 alone has memory for twice so many (about 500 MB)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    token_codec.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path, remembered=REMEMBERED)
    out = materialize(token_codec.read_tokens(spark, path), "token-rows")
    delete(spark, path)
    return out


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = language.predict(docs, language.train(docs))
    return rows.select("doc_id", F.coalesce(language.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), remembered=REMEMBERED)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.filter("vec_id % 50 = 0"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    out = materialize(mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken"), "taken")
    release(spark, *mixed)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model) if model else None
    return whitening.whiten(rows, model).withColumns({"deviation": F.expr("try_cast(deviation AS bigint)"), "identity_error": F.lit(error).cast("double")})


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return vector_codes.encode(rows, vector_codes.fit(rows)).withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ("error", "label_error")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_output": op2_token_output,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_topk": op10_topk,
    "op11_mixing": op11_mixing,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    """Phrases place by place, and every block against every template."""
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({t['words']!r}, '{t['label']}', {t['least']})" for t in licenses.template_index(licenses.TEMPLATES, 0.9, {}))
    return rf"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo FROM documents),
        w AS (SELECT doc_id, lo, regexp_extract_all(lo, '{WORDS}') AS w FROM d),
        p(words, label) AS (VALUES {phrases}), t(words, label, least) AS (VALUES {templates}),
        places AS (
            SELECT doc_id, label, unnest(list_filter(generate_series(0, len(w) - len(words)), lambda i: w[i + 1 : i + len(words)] = words)) AS place
            FROM w JOIN p ON contains(lo, words[1]) AND len(w) >= len(words)),
        blocks AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lo, '
|[.!?]+(\s|$)')) AS b FROM d),
        sets AS (SELECT doc_id, list_distinct(regexp_extract_all(b, '{WORDS}')) AS b FROM blocks),
        matched AS (
            SELECT doc_id, label, len(list_intersect(b, words)) / len(words) AS c FROM sets JOIN t ON len(b) >= least AND len(list_intersect(b, words)) >= least),
        base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
        every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM matched) GROUP BY 1),
        best AS (SELECT doc_id, max(c) AS c FROM matched GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
            CAST(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END AS DOUBLE) AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _codes_sql(rounds: int = 4) -> str:
    """Every part against every entry, round by round; vectors of one length that 4 divides."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
            SELECT vec_id, label, p, q, min({{'d': list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
            FROM parts JOIN c{r} USING (p) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
            SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
                SELECT p, m.e AS e, i, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n
                FROM (SELECT p, m, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
        c{r + 1} AS (SELECT p, e, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} s USING (p, e))""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, label, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS q FROM v, range(4) AS r(p)),
        c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM parts QUALIFY e < 256),
        {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op4_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        windows AS (SELECT doc_id, p, md5(substring(x, 2 * p - 1, 400)) AS s FROM (SELECT doc_id, x, unnest(generate_series(1, n - 199)) AS p FROM b)),
        hits AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
        marks AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS m FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        runs AS (SELECT doc_id, p, sum(m) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marks),
        spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM runs GROUP BY doc_id, k),
        edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM spans),
        pieces AS (
            SELECT doc_id, before AS place, substring(x, 2 * before - 1, 2 * (a - before)) AS x FROM edges JOIN b USING (doc_id)
            UNION ALL SELECT doc_id, z, substring(x, 2 * z - 1) FROM edges JOIN b USING (doc_id) WHERE last = 1),
        kept AS (SELECT doc_id, string_agg(x, '' ORDER BY place) AS x FROM pieces GROUP BY 1),
        counts AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256
        FROM b LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_near_duplicates": """
        WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node FROM documents GROUP BY 1),
        w AS (SELECT node, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM t),
        s AS (SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        c AS (SELECT node, g, count(*) AS c FROM s GROUP BY 1, 2), z AS (SELECT node, sum(c) AS n FROM c GROUP BY 1),
        o AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS both_ FROM c x JOIN c y ON x.g = y.g AND x.node <> y.node GROUP BY 1, 2),
        links AS (SELECT a, b FROM o JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE both_ >= 0.8 * (x.n + y.n - both_)),
        reach AS (SELECT node AS a, node AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        classes AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY 1), degree AS (SELECT a AS node, count(*) AS n FROM links GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN classes USING (node) LEFT JOIN degree USING (node)""",
    "op10_topk": """
        WITH codes AS (
            SELECT vec_id, string_agg(CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code
            FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
            GROUP BY vec_id),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code))::INT AS distance
            FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INT AS rank, neighbor_id, distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
        WHERE rank <= 10""",
    "op13_vector_codes": _codes_sql(),
}
