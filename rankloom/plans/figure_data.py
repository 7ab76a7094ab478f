"""The numbers behind figures, over events and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures
from .base import query, table

_N, _LOW, _HIGH = 40, 0.0, 400.0
_W = (_HIGH - _LOW) / _N


@query("value_density", f"""WITH d AS (SELECT event_type, value, least(greatest(floor((value - {_LOW}) / {_W}::DOUBLE), 0), {_N - 1})::INT AS b FROM events WHERE value IS NOT NULL), c AS (SELECT event_type, b, count(*) AS c FROM d GROUP BY 1, 2),
 s AS (SELECT event_type, count(*) AS n, greatest(coalesce(stddev_samp(value), 0) / pow(count(*)::DOUBLE, 0.2::DOUBLE), {_W}::DOUBLE) AS h FROM d GROUP BY 1), g AS (SELECT unnest(range({_N})) AS g)
 SELECT event_type, {_LOW}::DOUBLE + (g + 0.5::DOUBLE) * {_W}::DOUBLE AS at, round(sum(c * exp(-pow((g - b) * {_W}::DOUBLE / h, 2) / 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 9) AS density FROM c JOIN s USING (event_type), g GROUP BY event_type, g""")
def value_density(spark, sf_dir):
    d = figures.density(table(spark, sf_dir, "events"), ["event_type"], "value", _LOW, _HIGH, _N)
    return d.withColumn("density", F.round("density", 9))


@query("value_boxes", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
 i AS (SELECT event_type, value, q1, median, q3, value >= q1 - 1.5::DOUBLE * (q3 - q1) AND value <= q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM events JOIN q USING (event_type) WHERE value IS NOT NULL)
 SELECT event_type, count(*)::BIGINT AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(value) FILTER (WHERE inside) AS low_whisker, max(value) FILTER (WHERE inside) AS high_whisker, (count(*) FILTER (WHERE NOT inside))::BIGINT AS n_outliers FROM i GROUP BY 1""")
def value_boxes(spark, sf_dir):
    b = figures.boxes(table(spark, sf_dir, "events"), ["event_type"], "value")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("toxic_roc_curve", """WITH d AS (SELECT source, n_chars::DOUBLE AS s, toxic FROM documents JOIN labels USING (doc_id)), v AS (SELECT source, s, sum(toxic)::BIGINT AS p, count(*)::BIGINT - sum(toxic)::BIGINT AS n FROM d WHERE s IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(p) OVER w AS p2, lead(n) OVER w AS n2, row_number() OVER w AS i, sum(p) OVER (PARTITION BY source) AS ap, sum(n) OVER (PARTITION BY source) AS an FROM v WINDOW w AS (PARTITION BY source ORDER BY s DESC)),
 k AS (SELECT source, s AS threshold, tp, fp, ap, an FROM t WHERE i = 1 OR p2 IS NULL OR p * n2 <> n * p2 UNION ALL SELECT source, 'inf'::DOUBLE, 0, 0, any_value(ap), any_value(an) FROM t GROUP BY source)
 SELECT source, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / nullif(ap, 0), 9) AS tpr, round(fp::DOUBLE / nullif(an, 0), 9) AS fpr FROM k""")
def toxic_roc_curve(spark, sf_dir):
    """How well a text's length tells toxic ones, by source: the corners of the curves."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("n_chars").cast("double").alias("s"), "toxic")
    return figures.roc_curve(d, ["source"], "s", "toxic").withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})
