from lodewatch.operators import models


def test_versions_rollbacks_and_retraining(spark):
    log = spark.createDataFrame([], models.LOG)
    for step in (("a", "v1", 0.9), ("a", "v2", 0.7), ("b", "v1", 0.0)):
        log = log.unionByName(models.promoted(log, step[0], step[1], step[2], 0.5, 100, {"x": step[2]}))
    log = log.unionByName(models.rolled_back(log, "a", "v1")).unionByName(models.rolled_back(log, "b", "never"))
    now = {r.model: (r.version, r.accuracy, r.weights) for r in models.current(log).collect()}
    assert now == {"a": ("v1", 0.9, {"x": 0.9}), "b": ("v1", 0.0, {"x": 0.0})}
    history = [(r.model, r.seq, r.version, r.previous, r.promoted) for r in models.runs(log).orderBy("model", "seq").collect()]
    assert history == [("a", 0, "v1", None, True), ("a", 1, "v2", "v1", True), ("a", 2, "v1", "v2", False), ("b", 0, "v1", None, True), ("b", 1, "never", "v1", False)]
    rows = [("a", k, "bad", "bad" if k >= 5 and k % 4 else "good") for k in range(30)] + [("b", k, "good", "good") for k in range(9)] + [("c", k, "good", "good") for k in range(10)]
    feedback = spark.createDataFrame(rows, "model string, seq long, predicted string, actual string")
    got = {r.model: (r.n, r.accuracy, r.drop, r.due) for r in models.retrain(feedback, log).collect()}
    assert got == {"a": (20, 0.75, 0.15, True), "b": (9, 1.0, None, False), "c": (10, 1.0, None, True)}
    stats = {(r.model, r.predicted): (r.total, r.correct) for r in models.feedback_stats(feedback).collect()}
    assert stats["a", "bad"] == stats["a", None] == (30, sum(x[2] == x[3] for x in rows[:30])) and stats["c", "good"] == (10, 10)


def test_calibration_falls_back_to_manual_weights(spark):
    few = spark.createDataFrame([(0.1 * k, 1.0, "normal" if k < 2 else "malicious") for k in range(4)] + [(0.0, 0.0, "other")] * 9, "x double, y double, label string")
    assert models.calibrated(few, ["x", "y"], {"x": 0.4}) == ({"x": 0.4, "y": 0.05}, 0.0, 4)
    many = spark.createDataFrame([(float(k % 7), float(k % 3), "malicious" if k % 7 > 3 else "normal") for k in range(60)], "x double, y double, label string")
    weights, _, n = models.calibrated(many, ["x", "y"], {})
    assert n == 60 and weights["x"] > 0.5 and abs(weights["y"]) < weights["x"] / 5
