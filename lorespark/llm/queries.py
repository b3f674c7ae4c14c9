"""The registered queries of this subpackage, as the contracts fix them, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.embeddings import near_vectors
from lorespark.llm.exact_dedup import exact_dedup
from lorespark.llm.hmm_lm import score_texts
from lorespark.llm.html_extract import extract_text
from lorespark.llm.line_dedup import line_dedup
from lorespark.llm.mixing import mix_sources
from lorespark.llm.packing import pack_documents
from lorespark.llm.passages import repeated_passages
from lorespark.llm.prefix_trie import conversation_trie
from lorespark.llm.secrets import BASE_RULES, scan_secrets
from lorespark.llm.simhash import near_duplicates
from lorespark.llm.toxicity import score, train
from lorespark.llm.vantage import hard_negatives


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    locator = F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    out = exact_dedup(_read(spark, sf_dir, "documents"), locator=locator)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), with_ids=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))


    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in BASE_RULES]
    return out.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, _read(spark, sf_dir, "labels"))
    out = score(docs.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))), model)
    return out.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"), F.col("clean").alias("text"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_hmm_scoring": op6_hmm_scoring,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_html_extract": op11_html_extract,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

#: DuckDB's SQL for those queries that SQL can express.
ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op10_line_dedup": r"""
        WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        every AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM doc),
        l AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
            FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM every) WHERE n > 0),
        near AS (
            SELECT *, n + lead(n, 1) OVER w AS a1, n + lead(n, 1) OVER w + lead(n, 2) OVER w AS a2, n + lead(n, 1) OVER w + lead(n, 2) OVER w + lead(n, 3) OVER w AS a3,
                n + lag(n, 1) OVER w AS b1, n + lag(n, 1) OVER w + lag(n, 2) OVER w AS b2, n + lag(n, 1) OVER w + lag(n, 2) OVER w + lag(n, 3) OVER w AS b3
            FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
        ends AS (
            SELECT doc_id, j AS a, CASE WHEN n >= 4 THEN j WHEN a1 >= 4 THEN j + 1 WHEN a2 >= 4 THEN j + 2 WHEN a3 >= 4 THEN j + 3 END AS b FROM near
            UNION SELECT doc_id, CASE WHEN n >= 4 THEN j WHEN b1 >= 4 THEN j - 1 WHEN b2 >= 4 THEN j - 2 WHEN b3 >= 4 THEN j - 3 END, j FROM near),
        runs AS (
            SELECT ends.doc_id, a, string_agg(line, chr(10) ORDER BY j) AS run, list(i) AS places
            FROM ends JOIN l ON l.doc_id = ends.doc_id AND l.j BETWEEN a AND b GROUP BY ends.doc_id, a, b),
        gone AS (
            SELECT DISTINCT doc_id, unnest(places) AS i
            FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM runs) WHERE k > 1)
        SELECT every.doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted, coalesce(string_agg(gone.i::VARCHAR, ',' ORDER BY gone.i), '') AS deleted,
            coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY every.i), '') AS text
        FROM every LEFT JOIN gone ON every.doc_id = gone.doc_id AND every.i = gone.i GROUP BY every.doc_id
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (
            SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank,
                s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT * FROM n WHERE rank <= 10
    """,
    # CRC-32 of the decimal id, byte by byte and bit by bit, with the polynomial 0xEDB88320.
    "op13_prefix_trie": """
        WITH own AS (
            SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (
            SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda r, b: list_reduce([xor(r, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
            FROM own),
        rebuilt AS (
            SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
        px AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
        keyed AS (SELECT conv_id, depth, md5(turns[1:depth]::VARCHAR || depth) AS k, len(turns) = depth AS ends, coalesce(length(turns[depth].text), 0) AS chars, turns FROM px),
        node AS (
            SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN depth = 0 THEN 0 ELSE chars END) AS chars,
                sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM keyed GROUP BY k, depth),
        up AS (SELECT node.*, p.k AS parent FROM node LEFT JOIN keyed p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1),
        counted AS (SELECT up.*, (SELECT count(*) FROM up c WHERE c.parent = up.k) AS n_children FROM up),
        below AS (
            SELECT a.k, sum((c.n_children = 0)::INT) AS n_leaves, sum((c.n - 1) * c.chars) AS saved_tokens
            FROM counted c JOIN keyed a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.k)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
        FROM counted c JOIN below USING (k) LEFT JOIN node p ON p.k = c.parent
    """,
}
