"""Checklist ratings by the offline judge, agreement, adjudication and roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ratings as J
from .base import query, table

_ONE = [("Clarity", "c1", "the and for with from that"), ("Clarity", "c2", "les des une que"), ("Ambiguity", "a1", "der die das und"), ("Ambiguity", "a2", "license software"), ("HiddenReproducibility", "h1", "password token secret"), ("RepairReadiness", "r1", "tion ing ed")]
_TWO = [("Clarity", "c1", "house that the xyz qqq"), ("Clarity", "c2", "pour les vous der das"), ("Ambiguity", "a1", "und les des une qui"), ("Ambiguity", "a2", "copyright software license warranty notice"), ("HiddenReproducibility", "h1", "token email address secret phone"), ("RepairReadiness", "r1", "zzz yyy www ing ed")]


def _words(p):
    """What the judge reads of an item: its first five words of three letters or more."""
    import re

    return [w.lower() for w in re.findall(r"[a-zA-Z]{3,}", p)[:5]]


def _judge_sql(items) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{d}' AS dimension, '{i}' AS item, least(1.0::DOUBLE, ({' + '.join(f'''contains(low, '{w}')::INT''' for w in _words(p))}) / {len(_words(p))}.0::DOUBLE) AS score FROM low" for d, i, p in items
    )


_LOW = "low AS (SELECT doc_id, lower(text) AS low FROM documents)"
_RATED = lambda items: f"SELECT doc_id, dimension, item, score >= 0.25 AS value, round(0.5::DOUBLE + 0.49::DOUBLE * score, 3) AS confidence FROM ({_judge_sql(items)})"
_PAIRED = f"p AS (SELECT a.doc_id, a.dimension, a.item, a.value AS v1, b.value AS v2, a.confidence AS c1, b.confidence AS c2 FROM ({_RATED(_ONE)}) a JOIN ({_RATED(_TWO)}) b USING (doc_id, dimension, item))"
_VALUE = "CASE WHEN v1 = v2 THEN v1 WHEN round(abs(c1 - c2), 12) < 0.05 THEN v1 OR v2 WHEN c1 > c2 THEN v1 ELSE v2 END"


def _rate(spark, sf_dir, items):
    return J.judge("offline", key="doc_id").evaluate(table(spark, sf_dir, "documents"), items)


def _pairs(spark, sf_dir):
    return J.paired(_rate(spark, sf_dir, _ONE), _rate(spark, sf_dir, _TWO), "doc_id")


@query("offline_judge", f"WITH {_LOW} {_RATED(_ONE)}")
def offline_judge(spark, sf_dir):
    return _rate(spark, sf_dir, _ONE).drop("reason")


_KAPPA = """x AS (SELECT {by} count(*)::BIGINT AS n, avg((v1 = v2)::INT) AS po, avg(v1::INT) AS p1, avg(v2::INT) AS p2 FROM p {group}), k AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS pe FROM x)
 SELECT {by} n, round(po, 6) AS percent_agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS cohens_kappa FROM k"""


@query("agreement_kappa", f"WITH {_LOW}, {_PAIRED}, " + _KAPPA.format(by="dimension,", group="GROUP BY dimension"))
def agreement_kappa(spark, sf_dir):
    k = J.kappa(_pairs(spark, sf_dir), ["dimension"])
    return k.withColumns({c: F.round(c, 6) for c in ("percent_agreement", "cohens_kappa")})


@query("label_kappa", "WITH p AS (SELECT quality AS v1, toxic AS v2 FROM labels), " + _KAPPA.format(by="", group=""))
def label_kappa(spark, sf_dir):
    k = J.kappa(table(spark, sf_dir, "labels"), [], "quality", "toxic")
    return k.withColumns({c: F.round(c, 6) for c in ("percent_agreement", "cohens_kappa")})


@query("adjudicate", f"WITH {_LOW}, {_PAIRED} SELECT doc_id, dimension, item, {_VALUE} AS value, CASE WHEN v1 = v2 THEN 'both' WHEN round(abs(c1 - c2), 12) < 0.05 THEN 'both_partial' WHEN c1 > c2 THEN 'judge1' ELSE 'judge2' END AS source FROM p")
def adjudicate(spark, sf_dir):
    return J.adjudicate(_pairs(spark, sf_dir)).select("doc_id", "dimension", "item", "value", "source")


_ROLL = f"""{_LOW}, {_PAIRED}, r AS (SELECT doc_id, dimension, count(*) FILTER (WHERE {_VALUE})::BIGINT AS raw, count(*)::BIGINT AS total FROM p GROUP BY 1, 2),
 c AS (SELECT *, CASE WHEN dimension = 'Ambiguity' THEN total - raw ELSE raw END::DOUBLE AS corrected FROM r)"""


@query("checklist_rollup", f"WITH {_ROLL} SELECT doc_id, dimension, raw, total, corrected, round(CASE WHEN stddev_pop(corrected) OVER w > 0 THEN (corrected - avg(corrected) OVER w) / stddev_pop(corrected) OVER w ELSE 0 END, 6) AS z FROM c WINDOW w AS (PARTITION BY doc_id)")
def checklist_rollup(spark, sf_dir):
    return J.roll_up(J.adjudicate(_pairs(spark, sf_dir)), "doc_id").withColumn("z", F.round("z", 6))


@query("checklist_derived", f"WITH {_ROLL} SELECT doc_id, max(total - raw) FILTER (WHERE dimension = 'RepairReadiness')::BIGINT AS repair_difficulty, max(raw) FILTER (WHERE dimension = 'Ambiguity')::BIGINT AS ambiguity_count, bool_or(raw = 1) FILTER (WHERE dimension = 'HiddenReproducibility') AS hidden_s2r_present FROM c GROUP BY doc_id")
def checklist_derived(spark, sf_dir):
    d = J.derived(J.roll_up(J.adjudicate(_pairs(spark, sf_dir)), "doc_id"), "doc_id")
    return d.select("doc_id", "repair_difficulty", "ambiguity_count", "hidden_s2r_present")


#: (column, rater's checklist, dimension): ratings of 0 to 5 by how sure the judge is of a dimension's items.
_RATINGS = [("actionability", 1, "RepairReadiness"), ("clarity", 1, "Clarity"), ("specificity", 2, "Clarity"), ("technical_depth", 1, "Ambiguity"), ("expected_observed_alignment", 2, "Ambiguity"), ("causal_reasoning_quality", 2, "RepairReadiness")]
RATINGS_SQL = f"""WITH {_LOW}, {_PAIRED} SELECT doc_id, {', '.join(f"round(10 * (avg(c{i}) FILTER (WHERE dimension = '{d}') - 0.5::DOUBLE), 3) AS {c}" for c, i, d in _RATINGS)},
 bool_or(v1) FILTER (WHERE dimension = 'HiddenReproducibility')::INT::DOUBLE AS hidden_s2r_present, bool_or(v1 <> v2)::INT::DOUBLE AS contradiction_present FROM p GROUP BY doc_id"""


def ratings(spark, sf_dir):
    """(doc_id, six ratings of 0 to 5, hidden_s2r_present, contradiction_present) of each document, by two checklists of the offline judge."""
    of = lambda dim, e: F.when(F.col("dimension") == dim, e)
    cols = [F.round(10 * (F.avg(of(d, F.col(f"c{i}"))) - 0.5), 3).alias(c) for c, i, d in _RATINGS]
    flags = [F.max(of("HiddenReproducibility", F.col("v1"))).cast("double").alias("hidden_s2r_present"), F.max(F.col("v1") != F.col("v2")).cast("double").alias("contradiction_present")]
    return _pairs(spark, sf_dir).groupBy("doc_id").agg(*cols, *flags)
