from faircart.operators import experiments

LEDGER = "run_id string, phase string, parent_id string, state string, accepted_correct long, accepted_incorrect long, eligible_comparable long, peak_memory_mb double"
GATES = [("teacher", "accepted_precision", "least", 0.9), ("student", "eligible_coverage", "regression", 0.1), ("oracle", "eligible_coverage", "gain", 0.1), ("browser", "peak_memory_mb", "most", 500.0)]


def failures(spark, rows):
    gates = spark.createDataFrame(GATES, "phase string, metric string, rule string, bound double")
    got = experiments.gate_failures(spark.createDataFrame(rows, LEDGER), gates)
    return sorted((r.run_id, r.metric, r.issue) for r in got.collect())


def test_gates(spark):
    rows = [
        ("t1", "teacher", None, "keep", 90, 10, 100, None),
        ("t2", "teacher", None, "keep", 89, 11, 100, None),
        ("t3", "teacher", None, "discard", 0, 11, 100, None),
        ("t4", "teacher", None, "keep", 0, 0, 0, None),
        ("s1", "student", "t1", "keep", 80, 0, 100, None),
        ("s2", "student", "t1", "keep", 79, 0, 100, None),
        ("s3", "student", "t9", "keep", 99, 0, 100, None),
        ("o1", "oracle", "t1", "keep", 100, 0, 100, None),
        ("o2", "oracle", "t3", "keep", 9, 0, 100, None),
        ("b1", "browser", None, "keep", 0, 0, 0, 500.0),
        ("b2", "browser", None, "keep", 0, 0, 0, 501.0),
        ("b3", "browser", None, "keep", 0, 0, 0, None),
        ("x1", "other", None, "keep", 0, 0, 0, None),
    ]
    assert failures(spark, rows) == [
        ("b2", "peak_memory_mb", "missed"), ("b3", "peak_memory_mb", "unknown"), ("o2", "eligible_coverage", "missed"), ("s2", "eligible_coverage", "missed"),
        ("s3", "eligible_coverage", "no-parent"), ("t2", "accepted_precision", "missed"), ("t4", "accepted_precision", "missed"),
    ]
    assert failures(spark, []) == []


def test_policies(spark):
    gates = [*GATES, ("final", "accepted_precision", "least", 1.2), ("final", "x", "around", 1.0), ("a", "y", "most", 1.0), ("a", "y", "most", 2.0), ("a", "z", "most", None)]
    got = experiments.policy_issues(spark.createDataFrame(gates, "phase string, metric string, rule string, bound double"))
    assert sorted((r.metric, r.issue) for r in got.collect()) == [("accepted_precision", "bound-out-of-range"), ("x", "unknown-rule"), ("y", "repeated"), ("z", "bound-out-of-range")]
