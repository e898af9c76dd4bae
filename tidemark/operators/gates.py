"""Promotion gates in table form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bootstrap import paired_delta_ci
from tidemark.operators.metrics import operating_metrics


@dataclass(frozen=True)
class Policy:
    """Fixed values of the promotion policy."""

    min_delta: float = -0.01
    max_recall_drop: float = 0.02
    max_brier_rise: float = 0.02
    max_alerts_per_day: float = 10.0


def derived(report: DataFrame) -> DataFrame:
    """``report`` with the four gates and ``eligible`` that follow from its metrics and policy columns."""
    g = {
        "gate_ranking": F.col("delta_low") >= F.col("min_delta"),
        "gate_recall": F.col("candidate_recall") >= F.col("champion_recall") - F.col("max_recall_drop"),
        "gate_brier": F.col("candidate_brier") <= F.col("champion_brier") + F.col("max_brier_rise"),
        "gate_capacity": F.col("candidate_alerts_per_day") <= F.col("max_alerts_per_day"),
    }
    d = report.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in g.items()})
    return d.withColumn("eligible", F.col("gate_ranking") & F.col("gate_recall") & F.col("gate_brier") & F.col("gate_capacity"))


def promotion_gates(scores: DataFrame, champion: str, candidate: str, threshold: float, policy: Policy = Policy(), replicates: int = 500, seed: int = 42, candidate_threshold: float | None = None) -> DataFrame:
    """One row from paired scores (both columns on the same rows; y, day, ts_us), each model at its own threshold; the
    candidate's is the champion's where none is given."""
    a = operating_metrics(scores, threshold, p=champion).select(F.col("recall").alias("champion_recall"), F.col("brier").alias("champion_brier"))
    b = operating_metrics(scores, threshold if candidate_threshold is None else candidate_threshold, p=candidate).select(F.col("recall").alias("candidate_recall"), F.col("brier").alias("candidate_brier"), F.col("alerts_per_day").alias("candidate_alerts_per_day"))
    ci = paired_delta_ci(scores, champion, candidate, replicates, seed).select(F.col("low").alias("delta_low"), F.col("high").alias("delta_high"), "valid")
    d = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(ci))  # one row each
    return derived(d.withColumns({k: F.lit(v) for k, v in vars(policy).items()}))


def aligned(champion: DataFrame, candidate: DataFrame, key: str = "trans_num", p: str = "p") -> DataFrame:
    """Two score sets joined by key; an error where a row is in one alone."""
    a, b = champion.select(key, F.col(p).alias("p_champion")), candidate.select(key, F.col(p).alias("p_candidate"))
    d = a.join(b, key, "full_outer")
    if d.where("p_champion is null or p_candidate is null").limit(1).count():
        raise ValueError("the score sets don't cover the same rows")
    return d


def gate_mismatches(recorded: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(version, column_name) of recorded reports whose gates don't follow from their metrics, whose metrics aren't
    finite, or whose policy differs."""
    gates = ["gate_ranking", "gate_recall", "gate_brier", "gate_capacity", "eligible"]
    numbers = ["delta_low", "candidate_recall", "champion_recall", "candidate_brier", "champion_brier", "candidate_alerts_per_day"]
    again = derived(recorded.select("version", *numbers, *vars(policy))).select("version", *[F.col(g).alias(f"__{g}") for g in gates])
    d = recorded.join(again, "version")
    checks = [(g, F.col(g) != F.col(f"__{g}")) for g in gates]
    checks += [(n, F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))) for n in numbers]
    checks += [(k, ~F.col(k).eqNullSafe(F.lit(v))) for k, v in vars(policy).items()]
    bad = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("column_name"), F.coalesce(c, F.lit(True)).alias("bad")) for n, c in checks]), lambda x: x.bad)).alias("x")
    return d.select("version", bad).select("version", "x.column_name")


def status_summary(log: DataFrame) -> DataFrame:
    """Per version of a registry log (version, sequence, status, event_hash): current status, head and length."""
    return log.groupBy("version").agg(F.max_by("status", "sequence").alias("status"), F.max_by("event_hash", "sequence").alias("head"), F.count("*").alias("length"))
