"""The registered queries of this subpackage: thin forms over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import (
    ann_rpforest, bpe_forced, decontaminate_prefix, divergence_bitmaps, license_positional, merkle_witness, mixing,
    secret_lexer, simhash_vptree, token_counts, token_frames, topk_branch_bound, toxicity_channel)
from tidepool.llm.common import table
from tidepool.session import shared_dir


def vocab_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lexer.digests(secret_lexer.find_secrets(table(spark, sf_dir, "documents")))


def op3_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_channel.score_documents(docs, toxicity_channel.train(docs, table(spark, sf_dir, "labels")))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_forced.round_trip_digests(table(spark, sf_dir, "documents"), vocab_path())


def op5_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_rpforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_positional.scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocab_path(), limit=512)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_frames.write_token_files(table(spark, sf_dir, "documents"),
                                              shared_dir(spark, "token-files"), vocab_path(), end_id=2)
    return token_frames.read_token_files(manifest)


def op10_branch_bound_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_branch_bound.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_decontaminate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate_prefix.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate_prefix.digests(found)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    one_more = [F.col(f).cast("decimal(38,0)") + 1 if f == "n_chars" else F.col(f) for f in merkle_witness.FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = merkle_witness.build(docs, carried={"now": F.when(touched, merkle_witness.leaf_digest(one_more))})
    return merkle_witness.audited(manifest.witnesses(), "now")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_bitmaps.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_secret_spans, op3_toxicity_scores, op4_bpe_round_trip, op5_mix_to_targets,
        op6_rp_forest_neighbours, op7_license_labels, op8_token_counts, op9_token_files, op10_branch_bound_top_k,
        op11_decontaminate_items, op12_merkle_manifest, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op10_branch_bound_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
            WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_decontaminate_items": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN iw USING (win)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op12_merkle_manifest": """
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN FALSE ELSE xor(4294967295, list_reduce(
                list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
                    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                  ELSE xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 7 = 0 END AS touched
            FROM documents),
        fields AS (
            SELECT r, doc_id, lang,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
                    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS n_then,
                CAST(CAST(n_chars AS HUGEINT) + CASE WHEN touched THEN 1 ELSE 0 END AS VARCHAR) AS n_now,
                coalesce(strlen(text) || ':' || text, '-') AS z
            FROM docs),
        leaves AS (
            SELECT r, doc_id, lang, sha256(a || n_then || z) AS leaf,
                   sha256(a || coalesce(strlen(n_now) || ':' || n_now, '-') || z) AS now FROM fields),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                   count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        tree(lang, level, idx, n, d) AS (
            SELECT lang, 0, idx, n, leaf FROM ranked
            UNION ALL
            SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM tree
            WHERE n > 1 GROUP BY lang, level, idx // 2, n),
        subs AS (
            SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(level, idx, n, d) AS (
            SELECT 0, idx, n, d FROM subs
            UNION ALL
            SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM top
            WHERE n > 1 GROUP BY level, idx // 2, n),
        path AS (
            SELECT k.r, l.level, k.idx // CAST(power(2, l.level) AS BIGINT) % 2 AS side, t.d
            FROM ranked k JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM k.lang
            LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM k.lang AND t.level = l.level
                AND t.idx = xor(k.idx // CAST(power(2, l.level) AS BIGINT), 1)
            UNION ALL
            SELECT k.r, 1000 + l.level, s.idx // CAST(power(2, l.level) AS BIGINT) % 2, t.d
            FROM ranked k JOIN subs s ON s.lang IS NOT DISTINCT FROM k.lang CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
            LEFT JOIN top t ON t.level = l.level AND t.idx = xor(s.idx // CAST(power(2, l.level) AS BIGINT), 1)),
        steps AS (
            SELECT r, string_agg(d, '' ORDER BY level) AS proof,
                   list(CASE WHEN d IS NULL THEN '-' WHEN side = 1 THEN '<' || d ELSE '>' || d END ORDER BY level) AS s
            FROM path GROUP BY r),
        folded AS (
            SELECT k.r, k.doc_id, k.leaf, s.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
                list_reduce(list_concat([k.now], coalesce(p.s, [])),
                    lambda a, x: CASE x[1] WHEN '<' THEN sha256(x[2:] || a) WHEN '>' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root
            FROM ranked k JOIN subs s ON s.lang IS NOT DISTINCT FROM k.lang LEFT JOIN steps p USING (r))
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        occ AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        vocab AS (SELECT lang, term, sum(c) AS c FROM occ GROUP BY lang, term HAVING count(*) >= 10),
        sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM vocab GROUP BY lang),
        held AS (SELECT lang, source, term, sum(o.c) AS c FROM occ o JOIN vocab USING (lang, term) GROUP BY lang, source, term),
        sums AS (SELECT lang, source, sum(c) AS n FROM held GROUP BY lang, source),
        groups AS (SELECT DISTINCT lang, source FROM d),
        p AS (
            SELECT g.lang, g.source, t.term, coalesce(h.c, 0) AS c,
                   1 + (1000000000 * CAST(coalesce(h.c, 0) + 2 AS HUGEINT)) // (coalesce(s.n, 0) + 2 * z.v) AS p,
                   1 + (1000000000 * CAST(t.c + 2 AS HUGEINT)) // (z.n + 2 * z.v) AS q
            FROM groups g JOIN vocab t USING (lang) JOIN sizes z USING (lang)
            LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = t.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
        items AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
            FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
        ranked AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                   CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
