"""The operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import common, decontam, exact, lines, negatives, pages, passages, pieces, ranked, secret_scan, shards, simhash, token_counts, toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs, width=4, carry=["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item it holds at least four fifths of."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.contained(docs, items).select("doc_id", "item_id", "shared", "n_shingles")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_common(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.judged(docs, model).select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a passage of 50 words or more that is the same or nearly so."""
    return passages.find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = shards.assign(docs.withColumn("body", F.col("text")), text="body")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load of all documents, the removal of those labelled poor, and a recount of those labelled good.

    Documents labelled good are revised: their runs of white space become one space, and they move on to the
    next version of the tokenizer. The last batch is sent twice and counts once.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = common.table(spark, sf_dir, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    old, new = (open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read() for name in TOKENIZERS)
    loaded = common.stored(token_counts.measured(docs, TOKENIZERS[0], old, public_tokenizers.PATTERN))
    # Counts are joined and never texts, so a document of any length moves as one small row; merged at every size.
    good, poor = (labels.filter(f"quality = {q}").select("doc_id").hint("merge") for q in (1, 0))
    squeezed = docs.withColumn("text", F.regexp_replace("text", common.WHITE_RUN, " "))
    recounted = common.stored(token_counts.measured(squeezed, TOKENIZERS[1], new, public_tokenizers.PATTERN))
    rollup = token_counts.Rollup(spark, f"{common.shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1-load", token_counts.signed(loaded, 1))
    rollup.commit("2-remove", token_counts.signed(loaded.join(poor, "doc_id", "left_semi"), -1))
    revised = common.stored(
        token_counts.signed(loaded.join(good, "doc_id", "left_semi"), -1).unionByName(
            token_counts.signed(recounted.join(good, "doc_id", "left_semi"), 1)
        )
    )
    for _ in range(2):
        rollup.commit("3-revise", revised)
    return rollup.totals()


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model, digests=True).drop("text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.encode(exact.normalised(common.text_or_empty()), "UTF-8"), 256)
    return exact.mark(docs.withColumn("text_sha256", digest), carry=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [rule.kind for rule in secret_scan.BASE]
    return found.select(
        "doc_id",
        *[secret_scan.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secret_scan.listed(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, moved["vec_id"] % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.rank(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}

SQL = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        ds AS (
            SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d),
        bs AS (
            SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM b),
        sized AS (SELECT item_id, s, count(*) OVER (PARTITION BY item_id) AS n FROM bs)
        SELECT doc_id, item_id, count(*) AS shared, n AS n_shingles
        FROM ds JOIN sized USING (s) GROUP BY doc_id, item_id, n HAVING count(*) * 5 >= n * 4""",
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT d.doc_id, u.line, u.pos,
                translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS u(line, pos)),
        common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY body) AS group_size,
            row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) = 1 AS kept,
            sha256(body) AS text_sha256
        FROM t""",
    "op11_secret_scan": r"""
        WITH rules(kind, k, least, pattern) AS (VALUES
            ('assign', 0, 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]+'),
            ('access', 1, 18, 'AKIA[A-Z0-9]+'),
            ('hex', 2, 16, '[0-9a-f]+'),
            ('github', 3, 40, 'gh[pousr]_[A-Za-z0-9]+'),
            ('slack', 4, 20, 'xox[abprs]-[A-Za-z0-9-]+'),
            ('google', 5, 0, 'AIza[A-Za-z0-9_-]{35}'),
            ('private', 6, 0, '-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----'),
            ('login', 7, 0, '://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20"\x27/:@]{1,64}@')),
        parts AS (
            SELECT d.rowid AS r, doc_id, kind, k, least, regexp_extract_all(t, pattern) AS hits, list_transform(regexp_split_to_array(t, pattern), lambda x: length(x)) AS gaps
            FROM (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS t FROM documents) d, rules),
        placed AS (
            SELECT r, kind, k, least, u.hit, list_sum(gaps[1:u.pos]) + coalesce(list_sum(list_transform(hits[1:u.pos - 1], lambda x: length(x))), 0) AS s
            FROM parts, unnest(hits) WITH ORDINALITY AS u(hit, pos)),
        spans AS (
            SELECT r, kind, k, s, s + length(hit) AS e FROM placed
            WHERE length(hit) >= least AND (kind <> 'assign' OR length(regexp_extract(hit, '^[A-Za-z_]+["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12)),
        listed AS (
            SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k <= 2) AS base,
                string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
            FROM spans GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d LEFT JOIN listed ON listed.r = d.rowid""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        b AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        z AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
        tf AS (SELECT r, doc_id, len(t) AS n, u.term, count(*) AS tf FROM d, unnest(t) AS u(term) WHERE u.term IN (SELECT term FROM b) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, z GROUP BY term, n_docs),
        s AS (
            SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
            FROM tf JOIN w USING (term) JOIN b USING (term), z GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) <= 50""",
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
