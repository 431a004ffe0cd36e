"""Walks, complement sampling, translation embeddings, relational layers and ridge models against plain computations."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.operators import embed, linear, relational, transe, walks

PAIRS = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (6, 4), (1, 7), (8, 9)]


@pytest.fixture(scope="module")
def graph(spark):
    both = PAIRS + [(b, a) for a, b in PAIRS]
    return spark.createDataFrame([*both, both[0], (None, 1), (1, None)], "a long, b long")


def neighbours():
    out = collections.defaultdict(set)
    for a, b in PAIRS:
        out[a].add(b)
        out[b].add(a)
    return out


def transition(prev, at, p, q):
    near = neighbours()
    w = {x: 1 / p if x == prev else 1.0 if x in near[prev] else 1 / q for x in near[at]}
    return {x: v / sum(w.values()) for x, v in w.items()}


def test_second_order_walks_follow_their_probabilities(spark, graph):
    settings = [(1.0, 1.0), (0.25, 4.0), (4.0, 0.25)]
    rows = walks.second_order_walks(graph, 500, 5, settings, seed=3).collect()
    near = neighbours()
    assert collections.Counter((r.p, r.q) for r in rows) == {s: 500 * len(near) for s in settings}
    assert len({(r.p, r.q, r.start, r.walk) for r in rows}) == len(rows)
    seen = collections.defaultdict(collections.Counter)
    for r in rows:
        assert len(r.path) == 5 and r.path[0] == r.start and all(b in near[a] for a, b in itertools.pairwise(r.path))
        for prev, at, to in zip(r.path, r.path[1:], r.path[2:]):
            seen[r.p, r.q, prev, at][to] += 1
    checked = 0
    for (p, q, prev, at), found in seen.items():
        n = sum(found.values())
        for to, share in transition(prev, at, p, q).items():
            assert abs(found[to] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-9, (p, q, prev, at, to, found)
            checked += 1
    assert checked > 60


def test_walks_repeat_and_hubs_are_ranked_in_blocks(spark, graph):
    first = sorted(map(tuple, walks.second_order_walks(graph, 2, 4, seed=1).collect()))
    assert first == sorted(map(tuple, walks.second_order_walks(graph.repartition(7), 2, 4, seed=1).collect()))
    hub = [(0, i) for i in range(1, 400)]
    both = spark.createDataFrame([*hub, *((b, a) for a, b in hub)], "a long, b long")
    ranked, degrees = walks.ranked_neighbours(both, block=16)
    rows = ranked.collect()
    assert sorted(r.k for r in rows if r["at"] == 0) == list(range(399)) and {r.b for r in rows if r["at"] == 0} == set(range(1, 400))
    assert all((r.k, r.b, r.deg_b) == (0, 0, 399) for r in rows if r["at"] != 0) and degrees.filter("a = 0").first().deg == 399
    assert walks.second_order_walks(both.limit(0), 2, 4).count() == 0


@pytest.mark.parametrize("short", [64, 3])
def test_false_tails_by_rank(spark, short):
    rng = np.random.default_rng(4)
    n, first = 150, 1000
    edges = {(h, r, int(t) + first) for h in range(20) for r in range(2) for t in rng.choice(n, rng.integers(1, 30), replace=False)}
    edges |= {(50, 0, t + first) for t in range(n)} | {(51, 0, t + first) for t in range(n - 2)} | {(52, 0, 5)}
    df = spark.createDataFrame([*edges, next(iter(edges)), (None, 1, 1)], "h long, r int, t long")
    got = collections.defaultdict(list)
    for r in embed.filtered_negatives(df, n, 4, first=first, short=short).collect():
        got[r.h, r.r, r.t].append(r.neg)
    tails = collections.defaultdict(set)
    for h, r, t in edges:
        tails[h, r].add(t)
    for h, r, t in edges:
        free = set(range(first, first + n)) - tails[h, r]
        found = got[h, r, t]
        assert len(found) == len(set(found)) == min(4, len(free)) and set(found) <= free
    assert not got[50, 0, first] and sorted(got[51, 0, first]) == [first + n - 2, first + n - 1]


def test_false_tails_are_even_and_know_other_links(spark):
    edges = spark.createDataFrame([(h, 0, 0) for h in range(4000)], "h long, r int, t long")
    true = edges.select("h", "r", F.explode(F.array(F.lit(0), F.lit(3), F.lit(4))).alias("t"))
    found = collections.Counter(r.neg for r in embed.filtered_negatives(edges, 10, 1, true=true).collect())
    assert set(found) == {1, 2, 5, 6, 7, 8, 9} and all(abs(x - 4000 / 7) < 120 for x in found.values())


def test_transe_steps_follow_the_gradient():
    """One batch of plain steps equals finite differences of the loss, divided by the root of their mean square."""
    rng = np.random.default_rng(0)
    e, w = rng.normal(size=(6, 5)), rng.normal(size=(2, 5))
    h, r, t = np.array([0, 1, 2, 0]), np.array([0, 1, 0, 0]), np.array([3, 4, 5, 1])
    for norm in (1, 2):
        s = transe.Settings(dims=5, margin=3.0, norm=norm)
        new, head = None, None
        random = np.random.default_rng([7])
        order = random.permutation(4)
        new, head = random.integers(6, size=4), random.random(4) < 0.5

        def loss(e, w):
            hp, rp, tp = h[order], r[order], t[order]
            hn, tn = np.where(head, new, hp), np.where(head, tp, new)
            return np.maximum(s.margin + transe.lengths(e[hp] + w[rp] - e[tp], norm) - transe.lengths(e[hn] + w[rp] - e[tn], norm), 0).sum()

        moved, rel = e.copy(), w.copy()
        assert transe.block_steps(h, r, t, moved, rel, (np.zeros(6), np.zeros(2)), s, 0.1, [7]) == pytest.approx(loss(e, w))
        for m, out, at in ((e, moved, lambda x: loss(x, w)), (w, rel, lambda x: loss(e, x))):
            g = np.zeros_like(m)
            for i in np.ndindex(m.shape):
                d = np.zeros_like(m)
                d[i] = 1e-6
                g[i] = (at(m + d) - at(m - d)) / 2e-6
            want = m - 0.1 * g / np.sqrt((g * g).mean(1, keepdims=True) + 1e-10)
            assert np.allclose(out, want, atol=1e-4)


def test_transe_converges_and_keeps_the_best(spark):
    """A hub, several blocks, and links that follow from others."""
    town = [(f"p{i}", "lives", f"t{i % 12}") for i in range(300)] + [(f"t{i}", "in", f"c{i % 3}") for i in range(12)]
    land = [(f"p{i}", "of", f"c{i % 12 % 3}") for i in range(300)]
    held = land[::5]
    known = spark.createDataFrame([*town, *(x for x in land if x not in held), (None, "of", "c1")], "h string, r string, t string")
    losses = []
    done = transe.train(known, transe.Settings(dims=12, epochs=14, rate=0.3, block=200, batch=32, patience=1, least_rate=0.01), lambda i, x: losses.append(x))
    trail = sorted(done.trail.collect())
    assert [r.loss for r in trail] == losses and min(losses) < losses[0] / 3
    assert [r.best for r in trail] == [x < min([np.inf, *losses[:i]]) for i, x in enumerate(losses)]
    rates = [r.rate for r in trail]
    assert all(b in (a, a / 2) for a, b in itertools.pairwise(rates))
    rows = done.vectors.collect()
    assert collections.Counter(r.kind for r in rows) == {"entity": 315, "relation": 3}
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in rows if r.kind == "entity")
    asked = spark.createDataFrame([(h, r, t, i, int(t == c)) for i, (h, r, c) in enumerate(held) for t in [f"c{j}" for j in range(3)] + [f"t{j}" for j in range(12)]], "h string, r string, t string, i int, y int")
    found = embed.rank_evaluation(transe.scores(asked, done.vectors), ["i"]).first()
    assert found.n == len(held) and found.mrr > 2.5 * sum(1 / k for k in range(1, 16)) / 15
    assert transe.train(known.limit(0)).vectors.count() == 0


@pytest.mark.parametrize("how", ["sub", "mult", "corr"])
def test_relational_layers_against_numpy(spark, how):
    rng, d, n = np.random.default_rng(2), 6, 30
    edges = [(int(rng.integers(n - 3)), int(rng.integers(3)), int(rng.integers(n - 3))) for _ in range(200)] + [(0, 1, i) for i in range(20)]
    x, w = rng.normal(size=(n, d)), rng.normal(size=(3, d))

    def layer():
        return relational.Layer({r: rng.normal(size=2).tolist() for r in range(3)}, rng.normal(size=(2, d, d)), *(rng.normal(size=(d, d)) for _ in range(3)), *(rng.normal(size=d) for _ in range(4)), how)

    def comp(a, b):
        if how == "corr":
            return np.array([sum(a[i] * b[(i + k) % d] for i in range(d)) for k in range(d)])
        return a - b if how == "sub" else a * b

    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    relations = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "r int, w array<double>")
    rows = spark.createDataFrame([*edges, (999, 0, 1), (None, 0, 1)], "h long, r int, t long")
    for _ in range(2):
        now = layer()
        vectors, relations = relational.relational_layer(rows, vectors, relations, now)
        total = np.zeros((n, d))
        for h, r, t in edges:
            total[t] += comp(x[h], w[r]) @ sum(a * b for a, b in zip(now.coefficients[r], now.bases))
        y = (total @ now.w_in + np.array([comp(v, now.loop) for v in x]) @ now.w_loop) / 2 + now.bias
        y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5) * now.gain + now.shift
        x, w = np.maximum(y, 0), np.maximum(w @ now.w_rel, 0)
    assert np.allclose([r.v for r in sorted(vectors.collect())], x) and np.allclose([r.w for r in sorted(relations.collect())], w)


def plain_ridge(x, y, penalty):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return lambda a: y.mean() + (a - mean) @ w


def test_ridge_from_sums_against_plain_fits(spark, monkeypatch):
    monkeypatch.setattr(linear, "HELD_BYTES", 3000)
    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 3, 1] + [0, 50, 0, -7, 0]
    x[:, 4] = 2.5
    y = x @ [1, -0.2, 5, 0, 0] + rng.normal(size=n)
    z = [None if i % 7 == 0 else float(v) for i, v in enumerate(y * 3 + 1000)]
    kind = ["small" if i < 30 else f"k{i % 2}" for i in range(n)]
    fold, other = rng.integers(0, 5, n), np.where(rng.random(n) < 0.8, rng.integers(0, 2, n), linear.HELD_OUT)
    rows = spark.createDataFrame(
        [(i, v.tolist(), None if i % 10 == 0 else v[:2].tolist(), float(y[i]), z[i], ["ALL", kind[i]], int(fold[i]), int(other[i])) for i, v in enumerate(x)] + [(n, [1.0, float("nan"), 0.0, 0.0, 0.0], None, 1.0, 1.0, ["ALL"], 0, 0)],
        "key int, a array<double>, b array<double>, y double, z double, kinds array<string>, f int, g int",
    ).repartition(3)
    features = {"a": 5, "b": 2}
    got = linear.ridge_models(linear.fold_grams(rows, features, ["y", "z"], ["f", "g"], F.col("kinds")), [0.5, 50.0], 60).collect()
    at = {(r.family, r.target, r.split, r.slice, r.fold, r.penalty): r for r in got}
    want = 0
    for family, target, (split, folds), s, p in itertools.product(features, "yz", (("f", fold), ("g", other)), ("ALL", "k0", "k1", "small"), (0.5, 50.0)):
        v = np.array([float("nan") if t is None else t for t in (y if target == "y" else z)])
        use = np.isfinite(v) & ((family == "a") | (np.arange(n) % 10 != 0)) & ((s == "ALL") | (np.array(kind) == s))
        for k in np.unique(folds[use]):
            r = at.pop((family, target, split, s, int(k), p), None)
            if s == "small":
                assert r is None
                continue
            train, test, m = use & (folds != k) & (folds != linear.HELD_OUT), use & (folds == k), x[:, : features[family]]
            off = v[test] - plain_ridge(m[train], v[train], p)(m[test])
            assert (r.n_train, r.n_test) == (train.sum(), test.sum())
            assert r.rmse == pytest.approx(np.sqrt((off**2).mean()), rel=1e-6) and r.r2 == pytest.approx(1 - (off**2).sum() / ((v[test] - v[test].mean()) ** 2).sum(), rel=1e-6, abs=1e-6)
            want += 1
    assert not at and want == len(got)
    assert linear.ridge_models(linear.fold_grams(rows.limit(0), features, ["y"], ["f"]), [1.0]).count() == 0


def test_best_penalty_and_predictions(spark):
    models = spark.createDataFrame([("a", "y", f, p, r2, [1.0, 2.0, 3.0]) for p, fs in {0.1: [0.5, 0.7], 1.0: [0.6, 0.6], 9.0: [0.1, None]}.items() for f, r2 in enumerate(fs)], "family string, target string, fold int, penalty double, r2 double, weights array<double>")
    best = linear.best_penalty(models, ["family", "target"]).first()
    assert (best.penalty, round(best.mean_r2, 9), best.folds) == (0.1, 0.6, 2)
    rows = spark.createDataFrame([(1, [1.0, 10.0], 5.0), (2, None, 5.0), (3, [0.0, 1.0], None)], "key int, a array<double>, y double")
    (found,) = linear.predictions(rows, models.limit(1), {"a": 2}, ["y"], ["key"]).collect()
    assert (found.key, found.y, found.prediction) == (1, 5.0, 33.0)


def test_skip_gram_steps_follow_the_gradient():
    """One batch equals finite differences of the loss, divided by the root of their mean square."""
    from orefield.operators import skipgram

    rng = np.random.default_rng(3)
    v, u = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    s = skipgram.Settings(dims=4, negatives=2)
    found, often = skipgram.pairs([np.array([0, 1, 2]), np.array([3]), np.array([2, 4, 5, 1])], 2), np.array([1, 2, 2, 1, 1, 1])
    assert sorted(map(tuple, found.tolist())) == sorted([(a, b) for w in ([0, 1, 2], [2, 4, 5, 1]) for i, a in enumerate(w) for j, b in enumerate(w) if 0 < abs(i - j) <= 2])
    random = np.random.default_rng([9])
    order = random.permutation(len(found))
    share = np.cumsum(often**0.75)
    drawn = np.searchsorted(share, random.random((len(found), 2)) * share[-1], side="right")

    def loss(v, u):
        out = 0
        for (a, b), no in zip(found[order], drawn):
            out -= np.log(1 / (1 + np.exp(-v[a] @ u[b]))) + sum(np.log(1 - 1 / (1 + np.exp(-v[a] @ u[x]))) for x in no)
        return out

    new_v, new_u = v.copy(), u.copy()
    assert skipgram.block_steps(found, often, new_v, new_u, (np.zeros(6), np.zeros(6)), s, [9]) == pytest.approx(loss(v, u))
    for m, out, at in ((v, new_v, lambda x: loss(x, u)), (u, new_u, lambda x: loss(v, x))):
        g = np.zeros_like(m)
        for i in np.ndindex(m.shape):
            d = np.zeros_like(m)
            d[i] = 1e-6
            g[i] = (at(m + d) - at(m - d)) / 2e-6
        assert np.allclose(out, m - s.rate * g / np.sqrt((g * g).mean(1, keepdims=True) + 1e-10), atol=1e-4)


def test_skip_gram_tells_communities_apart(spark):
    from orefield.operators import skipgram

    rng = np.random.default_rng(4)
    paths = [[f"{g}{x}" for x in rng.integers(0, 20, 8)] for g in "ab" for _ in range(150)] + [["alone"], ["a1", None, "a2"]]
    walks = spark.createDataFrame([(p,) for p in paths], "path array<string>").repartition(3)
    done = skipgram.train(walks, skipgram.Settings(dims=8, epochs=4, block=60, batch=128))
    rows = {r.id: np.array(r.v) for r in done.vectors.filter("kind = 'node'").collect()}
    assert len(rows) == 41
    losses = [r.loss for r in sorted(done.trail.collect())]
    assert losses[-1] < losses[0] * 0.9
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items() if k != "alone"}
    hits = [k[0] == sorted((x for x in unit if x != k), key=lambda x: -unit[x] @ unit[k])[0][0] for k in unit]
    assert np.mean(hits) > 0.9
    assert skipgram.train(walks.limit(0)).vectors.count() == 0
