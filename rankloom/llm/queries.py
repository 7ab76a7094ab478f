"""The thin queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .line_dedup import LINES_SQL
from .mixing import MIX_SQL


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark, sf_dir):
    from .mixing import plan_mix

    m = plan_mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op2_near_duplicates(spark, sf_dir):
    from .near_dedup import classes

    return classes(_table(spark, sf_dir, "documents"), least=0.8, k=5).drop("h")


def op3_token_planes(spark, sf_dir):
    from .token_store import store_tokens

    return store_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op4_line_dedup(spark, sf_dir):
    from .line_dedup import drop_lines

    return drop_lines(_table(spark, sf_dir, "documents"), digest=True, at_least=10, shortest=1)


def op5_decontamination(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_transport_streams(spark, sf_dir):
    from .transport_stream import read_media, to_media

    return read_media(to_media(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark, sf_dir):
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op8_quality(spark, sf_dir):
    from .quality import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_secret_scan(spark, sf_dir):
    from .secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"), vocabulary=_tokenizer("word_bpe_49k.json"))


def op10_token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_ball_tree_top_k(spark, sf_dir):
    from .top_k import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op12_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, scale=256, positives=5, negatives=3)


def op13_keyed_upsert(spark, sf_dir):
    from .upsert import upsert_clients

    return upsert_clients(_table(spark, sf_dir, "clients"), _table(spark, sf_dir, "client_changes"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_near_duplicates, op3_token_planes, op4_line_dedup, op5_decontamination, op6_transport_streams, op7_toxicity, op8_quality, op9_secret_scan, op10_token_counts, op11_ball_tree_top_k, op12_hard_negatives, op13_keyed_upsert)}

TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLES: dict[str, str] = {"op1_source_mix": MIX_SQL, "op4_line_dedup": LINES_SQL, "op11_ball_tree_top_k": TOP_K_SQL, "op12_hard_negatives": NEGATIVES_SQL}
