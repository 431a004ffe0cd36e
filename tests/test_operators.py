"""Operators on small hand-written tables."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orefield.functions import strings as S
from orefield.functions import vectors as V
from orefield.operators import embed, features, metrics, rank, resolve, verify
from orefield.sources import extract, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, S.clean_null(F.lit(" nan "))) is None and one(spark, S.clean_null(F.lit(" a "))) == "a"
    assert one(spark, S.split_names(F.lit("a <|> <|>b"))) == ["a", "b"]
    assert one(spark, S.parse_number(F.lit("~120"))) == 120 and one(spark, S.parse_number(F.lit("x"))) is None
    assert one(spark, S.mofid_topology(F.lit("C.C MOFid-v1.pcu.cat0"))) == "pcu" and one(spark, S.mofid_topology(F.lit("MOFid-v1.ERROR.cat0"))) is None
    assert one(spark, S.strip_suffixes(F.lit("ABC_charged_Clean"))) == "ABC"
    assert one(spark, S.func_degree(F.lit("X_0.16_en"))) == 0.16 and one(spark, S.func_degree(F.lit("X_2"))) == 2
    assert [one(spark, S.crystal_system(F.lit(s))) for s in ("P-1", "C2/c", "Fm-3m", "Xyz")] == ["triclinic", "monoclinic", "cubic", None]
    assert one(spark, S.extract_doi(F.lit("https://doi.org/10.1%2Fx"))) == "10.1/x"
    assert one(spark, S.formula_fractions(F.lit("C2H6"), ["C", "H", "N"])) == [0.25, 0.75, 0.0]
    assert one(spark, S.norm_smiles(F.lit("['x','y']"))) == "x" and one(spark, S.norm_smiles(F.lit(" z "))) == "z"
    assert one(spark, S.names_match(F.lit("CO2 uptake"), F.lit("uptake")))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))
    assert one(spark, V.dot(a, b)) == 2 and one(spark, V.cosine(a, F.array(*[F.lit(0.0)] * 3))) == 0
    assert one(spark, V.circular_correlation(a, b)) == [2.0, 7.0, 3.0 + 0.0 * 2]


def test_csv_and_lists(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("k,v\n1, nan \n2,x\n")
    (tmp_path / "d" / ".b.csv").write_text("k,v\n9,z\n")
    got = tables.read_csv(spark, str(tmp_path / "d" / "a.csv"), "k string, v string").collect()
    assert [tuple(r) for r in got] == [("1", None), ("2", "x")]
    tree = tables.read_csv_tree(spark, str(tmp_path), "k string, v string").collect()
    assert {(r.k, r.source_file) for r in tree} == {("1", "a.csv"), ("2", "a.csv")}
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.validate_inputs(spark, [str(tmp_path), "/nowhere"])


def test_triples_round_trip(spark, tmp_path):
    rows = [("http://a#x", "http://p", 'say "hi"\n\\ok', "literal", None, "en"), ("_:b1", "http://p", "http://a#y", "uri", None, None), ("http://a#x", "http://p", "2.5", "literal", "http://d", None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    tables.write_triples(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_triples(spark, str(tmp_path / "t")).collect()), key=str) == sorted(rows, key=str)


def test_nested_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"identifiers": {"mp_id": "m1"}, "data": {"EgPBE": {"value": 2.0}, "pld": 3.5}}, {"identifiers": {}, "data": null}]')
    schema = "identifiers struct<mp_id: string>, data struct<EgPBE: struct<value: double>, pld: double>"
    docs = tables.read_documents(spark, str(tmp_path / "d.json"), schema, ["identifiers.mp_id"])
    got = extract.nested_properties(docs, F.col("identifiers.mp_id"), "data").collect()
    assert {(r.property_name, r.value) for r in got} == {("Band gap (PBE)", 2.0), ("Pore limiting diameter", 3.5)}


def test_text_mentions(spark):
    docs = spark.createDataFrame([("A", "BDC and bdc with pyridine"), ("B", None), ("C", "none")], "k string, t string")
    assert {tuple(r) for r in extract.text_mentions(docs, "k", F.col("t")).collect()} == {("A", "bdc"), ("A", "pyridine")}


def test_resolution(spark):
    rows = spark.createDataFrame([("a", 1, ["x"], None), ("a", 0, ["y", "x"], "f"), ("b", 1, [], None)], "k string, ord int, names array<string>, f string")
    got = {r.k: r for r in resolve.merge_by_key(rows, "k", "ord", ["names"], ["f"]).collect()}
    assert got["a"].names == ["x", "y"] and got["a"].f == "f" and got["b"].names == [] and got["b"].f is None
    with pytest.raises(ValueError, match="odd"):
        resolve.accumulate_relations({"odd": rows}, {"even"})
    known = spark.createDataFrame([("M1", "pcu", ["a"]), ("M2", "pcu", ["a", "b"])], "mof_id string, topology string, linkers array<string>")
    new = spark.createDataFrame([(1, "pcu", ["b", "c"]), (2, "pcu", ["a", "b", "c"])], "row_id int, topology string, components array<string>")
    assert [tuple(r) for r in resolve.structural_match(new, known).collect()] == [(2, "M1")]


def test_metrics(spark):
    scores = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (None, 3.0)], "y int, score double")
    assert metrics.roc_auc(scores).first().auc == pytest.approx(3.5 / 4)
    assert metrics.average_precision(scores).first().ap == pytest.approx((1 + 2 / 3) / 2)
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    assert metrics.regression_metrics(rows, "y", "p").first().r2 == pytest.approx(0.5)


def test_rank(spark):
    rows = spark.createDataFrame([(i, float(i), None if i % 2 else 1.0) for i in range(100)], "k int, a double, b double")
    got = rank.robust_scale(rows, {"a": False, "b": True})
    assert got.agg(F.min("a"), F.max("a"), F.count("b")).first() == Row(0.0, 1.0, 0)
    value, share = rank.weighted_average({"a": 1.0, "b": 3.0})
    assert tuple(rows.filter("k = 3").select(value, share).first()) == (3.0, 0.25)


def test_ids_and_walks(spark):
    ids = embed.dense_ids(spark.createDataFrame([(x,) for x in "abcaab"], "t string"), "t").collect()
    assert sorted(r.id for r in ids) == [0, 1, 2] and {r.t for r in ids} == set("abc")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "a long, b long")
    pairs = {(r.a, r.b) for r in edges.collect()}
    for r in embed.random_walks(edges, 2, 5).collect():
        assert len(r.path) == 5 and all(p in pairs for p in zip(r.path, r.path[1:]))


def test_transe_learns(spark):
    edges = spark.createDataFrame([(i, 0, i + 10) for i in range(10)], "h long, r int, t long")
    vectors = spark.createDataFrame([(i, [0.1 * ((i * 7 + k * 3) % 11 - 5) for k in range(4)]) for i in range(20)], "id long, v array<double>")
    relations = spark.createDataFrame([(0, [0.0] * 4)], "r int, w array<double>")
    new, rels = embed.transe_epoch(edges, vectors, relations, 4, 20, 0)
    assert all(r.n == pytest.approx(1) for r in new.select(V.norm(F.col("v")).alias("n")).collect()) and rels.count() == 1


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(200)
    a, b = (features.hash_split(r, ["id"], {"x": 0.5, "y": 0.5}).orderBy("id").collect() for r in (rows, rows.repartition(7)))
    assert a == b and 60 < sum(r.part == "x" for r in a) < 140


def test_overall_status(spark):
    checks = spark.createDataFrame([("PASS",), ("WARN",)], "status string")
    assert verify.overall_status(checks).first().status == "WARN" and verify.overall_status(checks.limit(0)).first().status == "PASS"


def test_rest_works_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "orefield", tmp_path / "orefield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'Q3_topology_histogram' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nearest_and_silhouette_score_every_row_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(230, 6)).astype(np.float32)
    v[40:60] = v[40]
    labels = [int(x) for x in rng.integers(0, 4, 229)] + [9]
    rows = spark.createDataFrame([(i, v[i].tolist(), labels[i]) for i in range(230)], "id long, v array<float>, label int").repartition(3)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = np.cumsum(unit[:, None] * unit[None], axis=2)[..., -1]
    want = {i: sorted((j for j in range(230) if j != i), key=lambda j: (-cosine[i, j], j))[:5] for i in range(230)}
    near = embed.nearest_by_cosine(rows, rows, "id", "v", 5, most_queries=50)
    got = {}
    for r in near.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.id)
    assert got == want
    purity = embed.knn_purity(near, rows, "id", "label").first()
    assert purity.n == 1150 and abs(purity.purity - np.mean([labels[i] == labels[j] for i in want for j in want[i]])) < 1e-9
    far = np.linalg.norm(v[:, None].astype(float) - v[None], axis=2)
    each = []
    for i in range(230):
        mean = {x: np.mean([far[i, j] for j in range(230) if j != i and labels[j] == x]) for x in set(labels) if any(j != i and labels[j] == x for j in range(230))}
        a, b = mean.get(labels[i]), min(d for x, d in mean.items() if x != labels[i])
        each.append(0 if a is None else (b - a) / max(a, b))
    found = embed.silhouette(rows, "id", "label", "v", most=60).first()
    assert found.n == 230 and abs(found.silhouette - np.mean(each)) < 1e-6
