"""Operators added later, on small tables with ties, gaps and damage."""

import random

from pyspark.sql import functions as F

from orefield.operators import embed, infer, metrics, rank, resolve, triples, verify
from orefield.schema import KG, ONTO, TYPE
from orefield.sources import tables
from orefield.sources.stored import written_once

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"


def test_repeated_attributes(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, None)], "k int, names array<string>")
    got = triples.entity_triples(rows, F.concat(F.lit("n"), F.col("k").cast("string")), ["Thing"], [triples.Attribute("hasName", F.col("names"), many=True)])
    assert sorted((r.s, r.p.split("#")[1], r.o.split("#")[-1]) for r in got.collect()) == [("n1", "hasName", "a"), ("n1", "hasName", "b"), ("n1", "type", "Thing"), ("n2", "type", "Thing")]


def test_negatives_are_complete(spark):
    full = [(0, 0, t) for t in range(28)]
    edges = spark.createDataFrame([*full, (1, 0, 5), (2, 0, 29)], "h long, r long, t long")
    got = embed.filtered_negatives(edges, 30, 2).collect()
    by_edge = {}
    for r in got:
        assert (r.h, r.r, r.neg) not in {*full, (1, 0, 5), (2, 0, 29)} and 0 <= r.neg < 30
        by_edge.setdefault((r.h, r.t), set()).add(r.neg)
    assert len(by_edge) == 30 and all(len(v) == 2 for v in by_edge.values())


def test_metrics_over_ranges_and_groups(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), float(rng.randrange(12))) for _ in range(300)]
    frame = spark.createDataFrame([(y, s, "g") for y, s in rows], "y int, score double, g string")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(y for y, t in rows if t >= s) / sum(t >= s for _, t in rows) for y, s in rows if y) / len(pos)
    for by in ([], ["g"]):
        assert abs(metrics.roc_auc(frame, by).first().auc - auc) < 1e-9
        assert abs(metrics.average_precision(frame, by).first().ap - ap) < 1e-9
    hits = metrics.hits_at(frame, ["g"], (1, 40)).first()
    first = {s: 1 + sum(t > s for _, t in rows) for _, s in rows}
    assert (hits.hits_1, hits.hits_40) == tuple(sum(y and first[s] <= k for y, s in rows) for k in (1, 40))


def test_capabilities_that_are_linked_already(spark):
    link = lambda s, p, o: (s, p if "/" in p else ONTO + p, o, "uri", None, None)
    name = lambda s, n: (s, ONTO + "hasPropertyName", n, "literal", None, None)
    rows = [link("a", "hasPhysicalProperty", "pa"), link("b", "hasPhysicalProperty", "pb"), link("c", "hasPhysicalProperty", "pc"), name("pa", "Price"), name("pb", "Price"), name("pc", "Price")]
    rows += [link("a", "hasCapability", KG + "CAP_1"), link(KG + "CAP_1", TYPE, ONTO + "Trade"), link("b", "hasCapability", ONTO + "Trade")]
    rules = spark.createDataFrame([(1, "price", "Trade")], "rule_id int, property string, capability string")
    assert [tuple(r) for r in infer.capabilities_from_names(spark.createDataFrame(rows, TRIPLE), rules).collect()] == [("c", "Trade", 1)]


def test_long_literals_come_back(spark, tmp_path):
    text = 'line "one"\n\\tail ' * 4000
    rows = spark.createDataFrame([("http://x/a", "http://x/p", text, "literal", "http://x/t", None), ("http://x/a", "http://x/q", "http://x/b", "uri", None, None), ("http://x/a", "http://x/r", 'a" . b', "literal", None, "en")], TRIPLE)
    tables.write_triples(rows, str(tmp_path / "t"))
    back = tables.read_triples(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert verify.read_back(rows, back).first().status == "PASS" and verify.read_back(rows, back.limit(2)).first().status == "FAIL"


def test_integrity_sees_losses(spark):
    base = spark.createDataFrame([("a", "p", str(i), "literal", None, None) for i in range(5)], TRIPLE)
    rich = base.filter("o <> '3'").union(spark.createDataFrame([("b", "p", "x", "literal", None, None)], TRIPLE))
    r = verify.data_integrity(base, rich).first()
    assert (r.lost, r.added, r.status) == (1, 1, "FAIL")


def test_source_choice_falls_back(spark):
    empty, full = spark.createDataFrame([], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    scores = spark.createDataFrame([("m1", "t", "ALL", 0.9), ("m2", "t", "ALL", 0.5)], "method string, target string, group string, r2 double")
    assert {r.source for r in rank.choose_source({"m1 out": empty, "m2 out": full}, scores, "t").collect()} == {"m2 out"}
    assert {r.source for r in rank.choose_source({"m2 out": full, "m1 out": full}, scores, "t").collect()} == {"m1 out"}
    assert {r.source for r in rank.choose_source({"m2 out": full, "m1 out": full}, scores, "other").collect()} == {"m2 out"}


def test_structural_match_takes_the_first(spark):
    rows = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", ["b"]), (3, "u", ["a", "b"])], "row_id int, topology string, components array<string>")
    known = spark.createDataFrame([(9, "t", ["a"]), (7, "t", ["b", "a"]), (5, "u", ["c"])], "mof_id int, topology string, linkers array<string>")
    assert [tuple(r) for r in resolve.structural_match(rows, known).collect()] == [(1, 7)]


def test_written_once_until_inputs_change(spark, tmp_path):
    source, calls = tmp_path / "in", []
    spark.range(3).write.parquet(str(source))

    def write(names, path):
        calls.append(names)
        for n in names:
            spark.range(1).write.parquet(f"{path}/{n}")

    first = written_once(spark, ["a", "b"], [str(source)], write)
    assert written_once(spark, ["b", "a"], [str(source)], write) == first[::-1] and calls == [["a", "b"]]
    spark.range(9).write.mode("overwrite").parquet(str(source))
    assert written_once(spark, ["a"], [str(source)], write) != first[:1] and calls == [["a", "b"], ["a"]]
