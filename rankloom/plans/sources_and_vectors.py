"""Embeddings, resuming, sources written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import vectors as V
from ..sources import reports as X
from ..sources import tables as T
from ..streaming import resume as R
from .base import query, table

_E = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query("embedding_summary", f"""SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS embedding_norm, round(list_avg(v), 6) AS embedding_mean, round(list_stddev_pop(v), 6) AS embedding_std, round(list_min(v), 6) AS embedding_min, round(list_max(v), 6) AS embedding_max,
 round(len(list_filter(v, lambda x: abs(x) < 0.01))::DOUBLE / len(v), 6) AS embedding_sparsity, round(len(list_filter(v, lambda x: x > 0))::DOUBLE / (len(list_filter(v, lambda x: x < 0)) + 1), 6) AS embedding_pos_neg_ratio FROM ({_E})""")
def embedding_summary(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(e, 6).alias(n) for n, e in V.summary(F.col("embedding")).items()])


@query("mean_pairwise_cosine", f"""WITH u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM ({_E})), c AS (SELECT label, count(*)::BIGINT AS n FROM u GROUP BY 1),
 s AS (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY 1)
 SELECT label, n, round(CASE WHEN n > 1 THEN (q - n) / (n * (n - 1)) ELSE 0 END, 6) AS cosine FROM q JOIN c USING (label)""")
def mean_pairwise_cosine(spark, sf_dir):
    return V.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding", 64).withColumn("cosine", F.round("cosine", 6))


@query("semantic_diversity")
def semantic_diversity(spark, sf_dir):
    """Turns of a conversation as sentences, by the stand-in embedding."""
    c = table(spark, sf_dir, "conversations").select("conv_id", V.hashed_embedding(F.col("text"), 16).alias("v"))
    return V.semantic_diversity(c, "conv_id", "v")


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    from ..operators import clusters

    return clusters.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10)


_DONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"


@query("resume_left_anti", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN ({_DONE})")
def resume_left_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.pending(o, o.filter("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("resume_union", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS source FROM orders")
def resume_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("source"))
    return R.resume(o, done, "o_orderkey", lambda d: d.select("o_orderkey", F.lit("new").alias("source")))


def _event_files(spark, sf_dir):
    """Two lots of files for a stream: the second sends part of the first again."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    again = e.filter(F.col("event_type") == "click")
    return e.filter("event_id % 2 = 0").unionByName(again), e.filter("event_id % 2 = 1").unionByName(again)


@query("process_once_stream", "SELECT event_id, user_id, event_type, CASE WHEN value > 10 THEN 'ok' ELSE 'failed' END AS status FROM events")
def process_once_stream(spark, sf_dir):
    """Events that arrive in two lots, part of them twice, annotated once each by a stream that is started again from its checkpoint."""
    src, out, mark = (scratch.folder(spark, f"stream-{x}") for x in ("source", "out", "checkpoint"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def annotate(batch):
        scored = batch.withColumn("score", F.when(F.col("value") > 10, F.log(F.col("value") - 10)))
        return R.with_status(scored, "score").drop("score", "value")

    for lot in _event_files(spark, sf_dir):
        lot.repartition(parts).write.mode("append").parquet(src)
        source = spark.readStream.schema(lot.schema).parquet(src)
        R.annotate_stream(source, "event_id", annotate, out, mark).awaitTermination()
    return T.read_batches(spark, out)


@query("run_counters", "SELECT batch::INT AS batch, count(*)::BIGINT AS processed, count(*) FILTER (WHERE p_brand = 'Brand#13')::BIGINT AS skipped, count(*) FILTER (WHERE p_size < 5 AND p_brand <> 'Brand#13')::BIGINT AS failed FROM (SELECT *, p_partkey % 4 AS batch FROM part) GROUP BY 1")
def run_counters(spark, sf_dir):
    """A run in four batches whose last two are tried again: counts that Spark observes while it writes, one row for each batch all the same."""
    out, log = scratch.folder(spark, "run"), scratch.folder(spark, "run-log")
    p = table(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_brand") == "Brand#13", "skipped").when(F.col("p_size") < 5, "failed").otherwise("ok"))
    counters = {"processed": F.count(F.lit(1)), "skipped": F.count_if(F.col("status") == "skipped"), "failed": F.count_if(F.col("status") == "failed")}
    for b in (0, 1, 2, 3, 2, 3):
        T.append_once(p.filter(F.col("p_partkey") % 4 == b).select("p_partkey", "status"), out, "first", b, counters, log)
    return spark.read.parquet(log).select(F.col("batch").cast("int"), "processed", "skipped", "failed")


@query("functional_gate_semi", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def functional_gate_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.gate(table(spark, sf_dir, "lineitem"), allowed, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("failed_items_status", "SELECT client_id, CASE WHEN segment IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(segment, 'Functional Issue') AS category FROM clients")
def failed_items_status(spark, sf_dir):
    c = table(spark, sf_dir, "clients").select("client_id", F.col("segment").alias("category"))
    return R.with_status(c, "category", "Functional Issue").select("client_id", "status", "category")


@query("windowed_totals", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_totals(spark, sf_dir):
    return R.windowed_totals(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("keys_of_file_names", "SELECT name, CASE WHEN ok THEN regexp_extract(name, '^defects4j-([^-]+)-(\\d+)\\.html$', 1) END AS project, CASE WHEN ok THEN regexp_extract(name, '^defects4j-([^-]+)-(\\d+)\\.html$', 2) END AS bug_id, CASE WHEN ok THEN 'processed' ELSE 'skipped' END AS status FROM (SELECT name, regexp_matches(name, '^defects4j-([^-]+)-(\\d+)\\.html$') AS ok FROM (SELECT CASE WHEN p_size % 5 = 0 THEN p_name ELSE 'defects4j-' || replace(p_brand, '#', '') || '-' || p_partkey || '.html' END AS name FROM part))")
def keys_of_file_names(spark, sf_dir):
    made = F.concat(F.lit("defects4j-"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-"), "p_partkey", F.lit(".html"))
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(made).alias("name"))
    return T.keys_of_names(p, "name", T.HTML_NAME, ("project", "bug_id"))


@query("report_ids_from_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '-' || c_custkey ELSE 'r' || c_custkey || '-' || c_custkey END AS id FROM customer")
def report_ids_from_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat("c_mktsegment", F.lit("_"), k, F.lit(".xml"))).otherwise(F.concat(F.lit("r"), k, F.lit(".xml")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.id_from_name(name, k).alias("id"))


@query("xml_round_trip", "SELECT 'B' || c_custkey AS title, 'a < b & c > ' || c_mktsegment AS description, 1::BIGINT AS n_files FROM customer")
def xml_round_trip(spark, sf_dir):
    """Reports made as XML strings, parsed by the same expressions that the XML source uses."""
    text = F.concat(F.lit("a &amp;lt; b &amp;amp; c &amp;gt; "), "c_mktsegment")
    xml = F.concat(F.lit('<bug id="'), "c_custkey", F.lit('"><buginformation><summary>B'), "c_custkey", F.lit("</summary><description>"), text, F.lit("</description></buginformation><fixedFiles><file>x.java</file></fixedFiles></bug>"))
    b = table(spark, sf_dir, "customer").select(F.from_xml(xml, X.BUG).alias("b"))
    return b.select(X.unescaped(F.col("b.buginformation.summary")).alias("title"), X.unescaped(F.col("b.buginformation.description")).alias("description"), F.size("b.fixedFiles.file").cast("long").alias("n_files"))


@query("latex_rows", "SELECT replace(p_name, '#', '\\#') || ' & ' || format('{:.2f}', p_retailprice) || ' \\\\' AS line FROM part")
def latex_rows(spark, sf_dir):
    return T.latex_rows(table(spark, sf_dir, "part"), ["p_name", "p_retailprice"])


@query("latex_table_round_trip", """SELECT c AS grp, 'Size_' || p_size || ' & more' AS feature, format('{:.6f}', avg(cents) / 100)::DOUBLE AS mean, format('{:.6f}', stddev_pop(cents) / 100)::DOUBLE AS std, min(cents) / 100.0::DOUBLE AS min, max(cents) / 100.0::DOUBLE AS max
 FROM (SELECT p_brand || ' 100%' AS c, p_size, round(p_retailprice * 100)::BIGINT AS cents FROM part) GROUP BY c, p_size""")
def latex_table_round_trip(spark, sf_dir):
    """Statistics by brand and size, written as a table with a row for each brand, and read back from the file."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    p = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit(" 100%")).alias("grp"), F.concat(F.lit("Size_"), "p_size", F.lit(" & more")).alias("feature"))
    d = p.agg((F.avg(cents) / 100).alias("mean"), (F.stddev_pop(cents) / 100).alias("std"), (F.min(cents) / 100).alias("min"), (F.max(cents) / 100).alias("max"))
    path = scratch.folder(spark, "latex")
    T.write_latex(T.latex_table(d, ["feature", "mean", "std", "min", "max"], ["Feature", "Mean", "STD", "Min", "Max"], group="grp", digits=6), path)
    return T.read_latex_stats(spark, path).withColumnRenamed("group", "grp")


@query("corpus_summary", "SELECT count(*)::BIGINT AS n, round(avg(n_chars), 4) AS mean_chars, sum(n_chars)::BIGINT AS chars, count(DISTINCT source)::BIGINT AS n_sources, round(avg((lang = 'en')::INT), 6) AS share_en FROM documents")
def corpus_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("n_sources"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("share_en"))
