"""The registered queries of this subpackage, ``opN_<name>``, and their DuckDB SQL where SQL can express them.

Each query applies its operator with production parameters to a whole table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import ann, bpe_trie, decontam, filter_audit, hard_negatives, language_id, packing, sharding, simhash, suffix_dedup, token_counts, token_index, toxicity
from tallywright.llm.common import BYTE_BPE, crc_of_id, materialize, table, text_or_empty

SHARDS = 16


def tokenizer_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_index.write_token_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_index.documents_of(store)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(3)) == 1
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_texts(docs, model).select("doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = text_or_empty("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(docs, SHARDS, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: ``n_passages``, the passages of over fifty words that occur elsewhere too (many are under 400
    bytes and stay), and ``repeats``, 1 where a document holds either kind."""
    cut = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), result="digest", passages=51)
    return cut.withColumn("repeats", ((F.col("n_removed") > 0) | (F.col("n_passages") > 0)).cast("int"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two branches read the histogram: written once, or all texts would be encoded twice
    histogram = materialize(token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path()), "lengths")
    return token_counts.context_limits(histogram)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2
    model = language_id.fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_trie.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded_col="decoded")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), digest("token_ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_bpe_trie": op11_bpe_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

_VECTORS = "SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    # both sides sum the products in the order of the components
    "op10_nearest_neighbours": f"WITH f AS ({_VECTORS}), s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score FROM f q JOIN f r ON r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20",
    "op12_hard_negatives": """WITH r AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON r.n <> a.n AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.n, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.n = p.n AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_filter_audit": f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic, len(v) < 200 AS a, 100 * len(list_distinct(v)) < 50 * len(v) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w LEFT JOIN marks USING (doc_id)),
mask AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS mask, count(*) AS n FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p JOIN l q ON q.x <> p.x JOIN l r ON r.x NOT IN (p.x, q.x) JOIN l s ON s.x NOT IN (p.x, q.x, r.x) JOIN l u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
f AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, mask, contains(mask, substr(filter_order, step, 1)) AS fails, regexp_matches(substr(filter_order, 1, step - 1), '[' || mask || '0]') AS gone FROM mask, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
t AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (mask = letter) AS unique_fails, sum(n * good) FILTER (fails AND NOT gone) AS good_lost, sum(n * toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM f GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM t""",
}
