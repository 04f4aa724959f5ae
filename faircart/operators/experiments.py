"""A ledger of experiment runs against the gates of a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import precision_bound

# Shares by the counts of a run, numerator and denominator.
SHARES = {
    "accepted_precision": ("accepted_correct", ("accepted_correct", "accepted_incorrect")),
    "eligible_coverage": ("accepted_correct", ("eligible_comparable",)),
    "abstention_recall": ("abstention_true_positive", ("abstention_true_positive", "abstention_false_negative")),
    "pointer_exact_share": ("pointer_exact", ("pointer_total",)),
    "grammar_validity": ("grammar_valid", ("grammar_total",)),
    "evidence_acceptance": ("evidence_accepted", ("evidence_total",)),
    "native_coverage": ("native_accepted_correct", ("native_eligible",)),
    "derived_coverage": ("derived_accepted_correct", ("derived_eligible",)),
}
#: Measures that a ledger gives as they are.
MEASURES = ("site_macro_coverage", "artifact_size_mb", "p50_latency_ms", "p95_latency_ms", "peak_memory_mb", "domain_count", "accepted_incorrect", "pointer_total")


def share(top: Column, *below: Column) -> Column:
    """A share of counts; 0 of nothing."""
    whole = sum((F.coalesce(b, F.lit(0)) for b in below), F.lit(0))
    return F.when(whole == 0, 0.0).otherwise(F.coalesce(top, F.lit(0)) / whole)


def run_metrics(ledger: DataFrame) -> DataFrame:
    """``(run_id, phase, parent_id, state, metric, value)``: what the gates may ask of each run, one row per metric.

    Shares come from the counts that the ledger has; those of absent columns are left out. ``accepted`` counts all that was
    accepted, ``precision_bound`` is the lower bound (95 %) of its precision.
    """
    have = set(ledger.columns)
    made = {m: share(F.col(a), *map(F.col, b)) for m, (a, b) in SHARES.items() if have.issuperset((a, *b))}
    made |= {m: F.col(m).cast("double") for m in MEASURES if m in have}
    if have.issuperset(("accepted_correct", "accepted_incorrect")):
        accepted = F.col("accepted_correct") + F.col("accepted_incorrect")
        made |= {"accepted": accepted.cast("double"), "precision_bound": precision_bound(accepted, F.col("accepted_incorrect"))}
    keys = ["run_id", "phase", "parent_id", "state"]
    wide = ledger.select(*keys, *(c.cast("double").alias(m) for m, c in made.items()))
    return wide.unpivot(keys, list(made), "metric", "value")


def gate_failures(ledger: DataFrame, gates: DataFrame, kept: str = "keep") -> DataFrame:
    """``(run_id, metric, rule, value, wanted, issue)``: what the kept runs of a ledger miss.

    ``gates(phase, metric, rule, bound)`` bound a metric by rule: ``least`` and ``most`` absolutely; ``gain`` asks for so much more than
    the parent run has, ``regression`` for no more than so much less. A metric that is unknown fails, and so does a relative
    rule without a parent in the ledger. Runs meet gates by phase and metric, and parents by key.
    """
    long = run_metrics(ledger)
    asked = long.where(F.col("state") == kept).join(gates, ["phase", "metric"])
    parents = long.select(F.col("run_id").alias("parent_id"), "metric", F.col("value").alias("before"), F.lit(True).alias("known")).dropDuplicates(["parent_id", "metric"])
    rows = asked.join(parents, ["parent_id", "metric"], "left")
    relative = F.col("rule").isin("gain", "regression")
    wanted = F.when(F.col("rule") == "gain", F.col("before") + F.col("bound")).when(F.col("rule") == "regression", F.col("before") - F.col("bound")).otherwise(F.col("bound"))
    missed = F.when(F.col("rule") == "most", F.col("value") > wanted).otherwise(F.col("value") < wanted)
    issue = F.when(relative & F.col("known").isNull(), "no-parent").when(F.col("value").isNull(), "unknown").when(F.coalesce(missed, F.lit(True)), "missed")
    return rows.select("run_id", "metric", "rule", "value", wanted.alias("wanted"), issue.alias("issue")).where("issue is not null")


def policy_issues(gates: DataFrame) -> DataFrame:
    """``(phase, metric, rule, issue)`` of gates that make no sense: unknown rules, bounds of shares outside 0 to 1, repeated gates."""
    shares = [*SHARES, "precision_bound", "site_macro_coverage"]
    times = gates.groupBy("phase", "metric", "rule").agg(F.count("*").alias("times"), F.min("bound").alias("low"), F.max("bound").alias("high"))
    issue = (
        F.when(~F.col("rule").isin("least", "most", "gain", "regression"), "unknown-rule")
        .when(F.col("times") > 1, "repeated")
        .when(F.col("low").isNull() | (F.col("metric").isin(*shares) & ((F.col("low") < 0) | (F.col("high") > 1))), "bound-out-of-range")
    )
    return times.select("phase", "metric", "rule", issue.alias("issue")).where("issue is not null")
