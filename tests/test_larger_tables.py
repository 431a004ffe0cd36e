"""What larger tables need: work done once, on the rows that need it, and results that don't change by it."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orefield.operators import learn


def described(spark):
    rows = [(i, i % 7, "abc"[i % 3] if i else None, f"C{i % 4}H2O" if i % 5 else None, f"part {i};x{i % 3}" if i % 6 else None) for i in range(60)]
    return spark.createDataFrame(rows, "key long, size int, brand string, formula string, name string")


def test_features_of_some_keys_are_those_of_all(spark):
    rows, only = described(spark), spark.range(0, 60, 9).toDF("key")
    make = lambda **more: {r.key: tuple(r.features) for r in learn.chemical_features(rows, "key", ["size"], {"brand": 2}, "formula", ["C", "H"], "name", 8, **more).collect()}
    whole, some = make(), make(only=only)
    assert set(some) == set(range(0, 60, 9)) and some == {k: whole[k] for k in some}


def test_fits_read_features_from_files(spark, monkeypatch):
    """No pass of a fit joins or computes features anew."""
    seen, rows = [], described(spark)

    class Model:
        setLabelCol = setFeaturesCol = lambda self, name: self

        def fit(self, train):
            seen.append(train)
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.col("label") + vector_to_array("features")[0] * 0)

    monkeypatch.setitem(learn.REGRESSORS, "plain", Model)
    features = learn.chemical_features(rows, "key", ["size"], {"brand": 2}, "formula", ["C"], "name", 8)
    targets = rows.select("key", F.col("size").cast("double").alias("a"), F.when(F.col("key") % 2 == 0, F.col("key")).alias("b"))
    out = {(r.family, r.target): r for r in learn.property_regression({"x": features}, targets, "key", ["a", "b"], ["plain"]).collect()}
    assert len(seen) == 2 and out["x", "a"].n + seen[0].count() == 60 and out["x", "b"].n + seen[1].count() == 30
    assert all(np.isclose(r.rmse, 0) for r in out.values())
    assert all("Join" not in t._jdf.queryExecution().optimizedPlan().toString() for t in seen)


def test_walks_over_links_that_stand_twice(spark, tmp_path):
    import duckdb

    from orefield.plans import registry

    # At 60 times sf0.1 parts have numbers of suppliers: two such parts may link to each other, or one to itself.
    links = [(1000001, 2), (1000002, 1), (1000003, 3), (1000001, 5), (7, 2), (1000003, 2)]
    spark.createDataFrame([(h, t, "A") for h, t in links], "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("E12_random_walks", "E12_second_order_walks", "E12_biased_walk_step"):
        rows = registry.queries()[name](spark, str(tmp_path))
        names = ', '.join(f'"{x}"' for x in rows.columns)
        result = con.execute(f"SELECT {names} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, rows.collect())) == sorted(result), name


def test_numbered_triples_are_made_from_tables_for_the_kinds_asked_for(spark, monkeypatch):
    """No stored texts stand behind them, no other kind is numbered, and they are those of the text graph."""
    from orefield.plans import star

    sf, kinds = "/root/testdata/sf0.001", ("capabilities", "functionalization_types", "topologies")
    want = star.graph(spark, sf, *kinds).collect()
    monkeypatch.setattr(star, "graph", None)
    rows, terms = star.encoded(spark, sf, [], *kinds)
    assert sorted(map(str, terms.text(terms.text(rows, "s"), "o").collect())) == sorted(map(str, want))
    assert {r.text for r in terms.table.collect()} == {x for r in want for x in (r.s, r.o)}


def test_repeated_triples_are_numbered_once_and_counts_are_deleted(spark, tmp_path):
    import os

    from orefield.operators import terms

    rows = spark.createDataFrame([("a", "p", "b"), ("a", "p", "b"), ("b", "p", "a")], "s string, p string, o string")
    terms.write(rows, f"{tmp_path}/g", ["p"])
    assert spark.read.parquet(f"{tmp_path}/g/triples").count() == 2 and "counted" not in os.listdir(f"{tmp_path}/g")


def test_additions_alone_differ_as_the_enriched_graph_does(spark, monkeypatch):
    """V12 compares what was added, not the graph with itself."""
    from orefield.operators import verify
    from orefield.plans import graph_queries

    sizes, own = [], verify.summary_difference
    monkeypatch.setattr(verify, "summary_difference", lambda base, more: (sizes.append((base, more)), own(base, more))[1])
    got = sorted(map(tuple, graph_queries.QUERIES["V12_summary_difference"](spark, "/root/testdata/sf0.001").collect()))
    (base, added), = sizes
    assert got == sorted(map(tuple, own(base, base.unionByName(added)).collect())) and added.count() < base.count()


def test_sums_by_row_are_those_of_a_plain_loop_to_the_last_bit():
    from orefield.operators import skipgram

    rng = np.random.default_rng(3)
    where, g = rng.integers(0, 50, 400) * 2, rng.normal(size=(400, 5))
    want = {}
    for i, x in zip(where, g):
        want[i] = want.get(i, np.zeros(5)) + x
    rows, summed = skipgram.summed_by_row(where, g, 120)
    assert rows.tolist() == sorted(want) and all((summed[j] == want[i]).all() for j, i in enumerate(rows))
    assert skipgram.summed_by_row(where[:0], g[:0], 120)[1].shape == (0, 5)
