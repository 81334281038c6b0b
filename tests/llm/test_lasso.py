import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from rowloom.llm import quality


def planted(rows=3000, columns=40):
    rng = np.random.default_rng(3)
    x = rng.random((rows, columns)) < rng.uniform(0.02, 0.98, columns)
    x[:, 5], x[:, 6], x[:, 7] = x[:, 4], ~x[:, 4], True  # the same, the opposite, always
    return x, rng.random(rows) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + x[:, 4] - 0.5)))


def test_fit_takes_few_jobs(spark):
    """A step of the lasso is no job: the driver's memory rose with the plans and classes of a hundred."""
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 600))
    rows = spark.createDataFrame([(float(x), float(y), float(x + y + z > 1.2)) for x, y, z in zip(a, b, rng.normal(0, 0.2, 600), strict=True)], "a double, b double, y double")
    spark.sparkContext.setJobGroup("fit", "fit")
    model = quality.fit(rows, ["a", "b"], "y")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setJobGroup("", "")
    assert len(model.rules) > 1 and len(jobs) <= 20


def test_least_loss():
    from rowloom.llm.lasso import lasso

    x, y = planted()
    for penalty in (5e-4, 0.02, 1.0):
        weights, intercept = lasso(x, y, penalty)
        off = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
        deviation = x.std(axis=0, ddof=1)
        slope = np.where(deviation > 0, (x * off[:, None]).mean(axis=0) / np.maximum(deviation, 1e-9), 0)
        assert abs(off.mean()) < 1e-6 and np.abs(slope).max() <= penalty + 1e-6
        assert np.allclose(slope[weights != 0], -penalty * np.sign(weights[weights != 0]), atol=1e-6)
        assert weights[7] == 0 and (weights != 0).any() == (penalty < 1)


def test_as_spark(spark):
    from rowloom.llm.lasso import lasso

    x, y = planted()
    keep = [*range(5), *range(8, 40)]  # without columns whose weights aren't unique
    df = spark.createDataFrame([(Vectors.dense(r.astype(float)), float(t)) for r, t in zip(x[:, keep], y, strict=True)], ["features", "label"])
    want = LogisticRegression(elasticNetParam=1.0, regParam=5e-3, maxIter=1000, tol=1e-12).fit(df)
    weights, intercept = lasso(x[:, keep], y, 5e-3)
    assert np.allclose(weights, want.coefficients.toArray(), atol=1e-3) and abs(intercept - want.intercept) < 1e-3


def test_other_labels(spark):
    """Label 1 counts against all others."""
    rows = spark.createDataFrame([(float(k % 10), 1.0 if k % 10 > 4 else 2.0 * (k % 2)) for k in range(200)], "a double, y double")
    scores = {r["a"]: r["s"] for r in rows.withColumn("s", quality.fit(rows, ["a"], "y").score()).collect()}
    assert all((s > 0.5) == (a > 4) for a, s in scores.items())
    assert quality.fit(rows.filter("y <> 1"), ["a"], "y").intercept == -20
