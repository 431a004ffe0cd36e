"""Probes against plain Newton fits, and the table of classes."""

import numpy as np
import pytest

from orefield.operators import metrics, probes
from orefield.operators.features import hash_share


def test_probes_against_plain_fits(spark):
    rng = np.random.default_rng(8)
    x = {"one": rng.normal(size=(300, 4)), "two": rng.normal(size=(300, 4)) * 2 + 1}
    truth = {"big": x["one"][:, 0] + rng.normal(size=300) > 0.8, "odd": x["two"][:, 1] - x["two"][:, 2] > 3, "never": np.zeros(300, bool)}
    tables = {m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(900, [1.0, None, 1.0, 1.0]), (901, None)], "key long, v array<double>") for m, v in x.items()}
    labels = spark.createDataFrame([(i, k, None if k == "big" and i % 9 == 0 else int(y[i])) for k, y in truth.items() for i in range(300)] + [(900, "big", 1)], "key long, concept string, y int")
    got = {(r.method, r.concept, r.seed): r for r in probes.logistic_probes(tables, labels, "key", "v", seeds=2).collect()}
    assert set(got) == {(m, k, s) for m in x for k in ("big", "odd") for s in (0, 1)}
    for (m, k, s), r in got.items():
        shares = np.array([v for _, v in sorted((t[0], t[1]) for t in spark.range(300).select("id", hash_share("id", seed=s)).collect())])
        known = np.ones(300, bool) if k == "odd" else np.arange(300) % 9 != 0
        train, test = known & (shares < 0.8), known & (shares >= 0.8)
        y, z = truth[k].astype(float), np.column_stack([np.ones(300), x[m]])
        weight = np.where(y == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (1 - y)[train].sum()))
        w = np.zeros(5)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            ridge = np.diag([0.0, 1, 1, 1, 1])
            g = z[train].T @ (weight * (p - y))[train] + ridge @ w
            w -= np.linalg.solve((z[train] * (weight * p * (1 - p))[train, None]).T @ z[train] + ridge + 1e-12 * np.eye(5), g)
        assert np.allclose(r.direction, w[1:] / np.linalg.norm(w[1:]), atol=1e-5)
        score = z[test] @ w
        pos, neg = score[y[test] == 1], score[y[test] == 0]
        assert r.n == test.sum() and r.auc == pytest.approx(((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean(), abs=1e-9)


def test_summary_and_cosines(spark):
    rows = spark.createDataFrame([("a", "k", s, 0.5 + s / 10, 9, [1.0, 0.0]) for s in range(2)] + [("b", "k", s, 0.7, 9, [0.6, 0.8]) for s in range(2)], "method string, concept string, seed int, auc double, n long, direction array<double>")
    found = {r.method: (round(r.auc_mean, 6), round(r.auc_std, 6), r.seeds) for r in probes.probe_summary(rows).collect()}
    assert found == {"a": (0.55, 0.05, 2), "b": (0.7, 0.0, 2)}
    (r,) = probes.cross_method_cosines(rows).collect()
    assert (r.concept, r.a, r.b, round(r.cosine, 9)) == ("k", "a", "b", 0.6)


def test_class_table(spark):
    rows = spark.createDataFrame([("x", 0.0, 0.0, 0.0), ("x", 0.0, 1.0, 0.0), ("y", 1.0, 1.0, 0.0), ("z", 2.0, 0.0, 0.0)], "name string, y double, forest double, most double")
    found = {r.name: r.asDict() for r in metrics.class_table(rows, {"f": "forest", "m": "most"}).collect()}
    assert found["x"] == {"name": "x", "n": 2, "found_f": 1, "said_f": 2, "found_m": 2, "said_m": 4} and found["y"]["found_f"] == 1 and found["z"] == {"name": "z", "n": 1, "found_f": 0, "said_f": 0, "found_m": 0, "said_m": 0}
