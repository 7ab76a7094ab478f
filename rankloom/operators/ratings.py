"""Checklist ratings: the offline judge, agreement of two raters, adjudication and the roll-up by dimension.

A checklist is rows (dimension, item, prompt); judgements are rows (bug, dimension, item, value, confidence).
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INVERTED = ("Ambiguity",)


class Judge(Protocol):
    """Rates every item of a checklist for every report: (key, dimension, item, value, confidence, reason)."""

    def evaluate(self, reports: DataFrame, checklist: list[tuple[str, str, str]]) -> DataFrame: ...


class OfflineJudge:
    """A deterministic judge that needs no network: the share of an item's first five words of three letters or more that the text contains."""

    def __init__(self, name: str = "offline", key: str = "bug_id", text: str = "text", threshold: float = 0.25):
        self.name, self.key, self.text, self.threshold = name, key, text, threshold

    def evaluate(self, reports: DataFrame, checklist: list[tuple[str, str, str]]) -> DataFrame:
        low = F.lower(F.coalesce(F.col(self.text), F.lit("")))
        items = []
        for dim, item, prompt in checklist:
            words = [w.lower() for w in re.findall(r"[a-zA-Z]{3,}", prompt)[:5]]
            hits = sum((F.contains(F.col("_low"), F.lit(w)).cast("int") for w in words), F.lit(0))
            score = F.least(F.lit(1.0), hits / F.lit(float(max(1, len(words)))))
            items.append(F.struct(F.lit(dim).alias("dimension"), F.lit(item).alias("item"), score.alias("score"), F.lit(prompt).alias("prompt")))
        d = reports.select(self.key, low.alias("_low")).select(self.key, F.explode(F.array(*items)).alias("x")).select(self.key, "x.*")
        reason = F.concat(F.lit("matched "), F.floor(F.col("score") * 100).cast("string"), F.lit("% of the words of '"), "prompt", F.lit("'"))
        return d.select(self.key, "dimension", "item", (F.col("score") >= self.threshold).alias("value"), F.round(0.5 + 0.49 * F.col("score"), 3).alias("confidence"), reason.alias("reason"))


def judge(kind: str = "offline", **how) -> Judge:
    """A judge by type. Remote ones are not part of this engine, which makes no network calls."""
    if kind in ("offline", "mock"):
        return OfflineJudge(**how)
    raise NotImplementedError(f"no judge of type {kind} without a network")


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Judgements of two raters side by side, with agreement and the difference of confidence."""
    on = [key, "dimension", "item"]
    x = a.select(*on, F.col("value").alias("v1"), F.col("confidence").alias("c1"))
    y = b.select(*on, F.col("value").alias("v2"), F.col("confidence").alias("c2"))
    return x.join(y, on).withColumns({"agree": F.col("v1") == F.col("v2"), "confidence_gap": F.abs(F.col("c1") - F.col("c2"))})


def kappa(pairs: DataFrame, by: list[str], v1: str = "v1", v2: str = "v2") -> DataFrame:
    """(by, n, percent_agreement, cohens_kappa); 1 where chance alone agrees always, 0 without items."""
    a, b = F.col(v1).cast("int"), F.col(v2).cast("int")
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("po"), F.avg(a.cast("double")).alias("p1"), F.avg(b.cast("double")).alias("p2"))
    pe = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    k = F.when(F.col("n") == 0, 0.0).when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe))
    return out.select(*by, "n", F.coalesce("po", F.lit(0.0)).alias("percent_agreement"), F.coalesce(k, F.lit(0.0)).alias("cohens_kappa"))


def adjudicate(pairs: DataFrame, close: float = 0.05) -> DataFrame:
    """Add value and source: what both say, else either's yes if they are about as sure, else what the surer one says."""
    near = F.round(F.abs(F.col("c1") - F.col("c2")), 12) < close
    value = F.when(F.col("v1") == F.col("v2"), F.col("v1")).when(near, F.col("v1") | F.col("v2")).when(F.col("c1") > F.col("c2"), F.col("v1")).otherwise(F.col("v2"))
    source = F.when(F.col("v1") == F.col("v2"), "both").when(near, "both_partial").when(F.col("c1") > F.col("c2"), "judge1").otherwise("judge2")
    return pairs.withColumns({"value": value, "source": source})


def roll_up(judgements: DataFrame, key: str, inverted: tuple[str, ...] = INVERTED) -> DataFrame:
    """(key, dimension, raw, total, corrected, z): yes counts, turned round for inverted dimensions, and their population z within the report (0 if all are equal)."""
    d = judgements.groupBy(key, "dimension").agg(F.count_if("value").alias("raw"), F.count("*").alias("total"))
    d = d.withColumn("corrected", F.when(F.col("dimension").isin(*inverted), F.col("total") - F.col("raw")).otherwise(F.col("raw")).cast("double"))
    w = W.partitionBy(key)
    sd = F.stddev_pop("corrected").over(w)
    return d.withColumn("z", F.when(sd > 0, (F.col("corrected") - F.avg("corrected").over(w)) / sd).otherwise(0.0))


def derived(rolled: DataFrame, key: str) -> DataFrame:
    """One row for each report: repair_difficulty, ambiguity_count, hidden_s2r_present, root_cause_evidence, impact_scope; null without the dimension."""
    pick = lambda dim, e: F.max(F.when(F.col("dimension") == dim, e))
    return rolled.groupBy(key).agg(
        pick("RepairReadiness", F.col("total") - F.col("raw")).alias("repair_difficulty"),
        pick("Ambiguity", F.col("raw")).alias("ambiguity_count"),
        pick("HiddenReproducibility", F.col("raw") == 1).alias("hidden_s2r_present"),
        pick("RootCauseEvidence", F.col("raw")).alias("root_cause_evidence"),
        pick("ImpactScope", F.col("raw")).alias("impact_scope"),
    )


def judgement_map(judgements: DataFrame, key: str) -> DataFrame:
    """One row for each report with the nested map dimension -> item -> (value, confidence, reason)."""
    entry = F.struct("item", F.struct("value", "confidence", "reason"))
    inner = judgements.groupBy(key, "dimension").agg(F.map_from_entries(F.collect_list(entry)).alias("items"))
    return inner.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "items"))).alias("judgement"))


def parse_answers(df: DataFrame, answer: str, items: list[str]) -> DataFrame:
    """(all columns, item, value, confidence, reason) of a model's JSON answer {item: {value, confidence, reason}}; an item that is missing is no, with confidence 0."""
    from ..functions.text import clean_response

    m = F.from_json(clean_response(F.col(answer)), "map<string,struct<value:boolean,confidence:double,reason:string>>", {"mode": "PERMISSIVE"})
    d = df.withColumn("_m", m).withColumn("item", F.explode(F.array(*[F.lit(i) for i in items])))
    got = F.try_element_at(F.col("_m"), F.col("item"))
    return d.withColumns({"value": F.coalesce(got["value"], F.lit(False)), "confidence": F.coalesce(got["confidence"], F.lit(0.0)), "reason": F.coalesce(got["reason"], F.lit("Missing from model response"))}).drop("_m")
