"""Numbers for terms: what is written comes back, hashes may be shared, rules give the same on numbers as on texts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orefield.operators import infer, terms, verify
from orefield.schema import CHAINS, KG, ONTO, TRIPLE, TYPE

CONSTANTS = [ONTO + "MOF", ONTO + "Trade", ONTO + "Cheap", ONTO + "DirectAirCapture"]


def link(s, p, o):
    return KG + s, p if "/" in p else ONTO + p, o if "/" in o else KG + o, "uri", None, None


def literal(s, p, o):
    return KG + s, ONTO + p, o, "literal", None, None


def small_graph():
    rows = []
    for i in range(40):
        rows += [link(f"m{i}", TYPE, ONTO + "MOF"), link(f"m{i}", "hasPhysicalProperty", f"p{i}"), literal(f"p{i}", "hasPropertyName", ("Price", "Size", "")[i % 3]), literal(f"p{i}", "hasValue", str(i) if i % 7 else "none")]
        rows += [literal(f"p{i}", "hasUnits", "USD")] * (i % 2) + [link(f"m{i}", "hasSynthesisProcess", f"s{i % 4}")]
    rows += [link(f"s{i}", "usesSolvent", "water") for i in range(4)] + [link("m1", "directlyUsesSolvent", "water"), link("m3", "hasCapability", "cap"), link("cap", TYPE, ONTO + "Trade")]
    rows += [link("m2", "hasFunctionalization", "f"), link("f", "hasFunctionalizationType", "Type_amine"), literal("m5", "hasName", "x" * 100_000)]
    return rows


def stored(spark, rows, path, bits):
    graph = spark.createDataFrame(rows, TRIPLE)
    terms.write(graph, path, ["p"], CONSTANTS, bits)
    numbers = spark.read.schema("s long, o long, o_kind string, datatype string, lang string, p string").parquet(path + "/triples").select(*TRIPLE.fieldNames())
    return graph, numbers, terms.read(spark, path, bits)


@pytest.mark.parametrize("bits", [56, 4])
def test_numbers_stand_for_texts(spark, tmp_path, bits):
    graph, numbers, known = stored(spark, small_graph(), str(tmp_path / "g"), bits)
    table = known.table.collect()
    assert len({r.id for r in table}) == len({r.text for r in table}) == len(table)
    assert {r.text for r in table} == {x for r in small_graph() for x in (r[0], r[2])} | set(CONSTANTS)
    assert (known.clashes.count() > 0) == (bits == 4)
    back = known.text(known.text(numbers, "s"), "o")
    assert back.columns == graph.columns and sorted(back.collect(), key=str) == sorted(graph.collect(), key=str)
    again = known.number(known.number(graph, "s"), "o")
    assert sorted(again.collect(), key=str) == sorted(numbers.collect(), key=str)
    assert all(numbers.filter(F.col("o") == known.of(x)).count() == sum(r[2] == x for r in small_graph()) for x in (ONTO + "MOF", KG + "water", "USD", ""))
    nulls = known.text(spark.createDataFrame([(None, 1), (None, 1)], "s long, n int"), "s")
    assert [tuple(r) for r in nulls.collect()] == [(None, 1), (None, 1)]


@pytest.mark.parametrize("bits", [56, 4])
def test_rules_on_numbers_and_on_texts(spark, tmp_path, bits):
    graph, numbers, known = stored(spark, small_graph(), str(tmp_path / "g"), bits)
    graph, numbers = graph.distinct(), numbers.distinct()
    names = spark.createDataFrame([(1, "price", "Trade")], "rule_id int, property string, capability string")
    limits = spark.createDataFrame([(2, "size", 5.0, 30.0, None, "Cheap"), (3, "price", None, 9.0, "USD", "Cheap")], "rule_id int, property string, low double, high double, unit string, capability string")
    chains = spark.createDataFrame(CHAINS, "first string, second string, inferred string")
    plain, rich = infer.enrich(graph, chains, names, limits), infer.enrich(numbers, chains, names, limits, known)
    assert sorted(known.text(known.text(rich, "s"), "o").collect(), key=str) == sorted(plain.collect(), key=str)
    added = {(r.s, r.p, r.o) for r in plain.collect()} - {r[:3] for r in small_graph()}
    want = {(KG + f"m{i}", ONTO + "directlyUsesSolvent", KG + "water") for i in range(40) if i != 1} | {(KG + "m2", ONTO + "hasCapability", ONTO + "DirectAirCapture")}
    # An empty name is a part of every rule's; it fits by name, not by value.
    want |= {(KG + f"m{i}", ONTO + "hasCapability", ONTO + "Trade") for i in range(40) if i % 3 != 1 and i != 3}
    want |= {(KG + f"m{i}", ONTO + "hasCapability", ONTO + "Cheap") for i in range(40) if i % 7 and (i % 3 == 1 and 5 <= i <= 30 or i % 3 == 0 and i <= 9)}
    assert added == want
    one, other = verify.data_integrity(graph, plain).first(), verify.data_integrity(numbers, rich).first()
    assert one == other and (one.lost, one.added, one.status) == (0, len(want), "PASS")
    less = rich.filter(F.col("s") != known.of(KG + "m1"))
    assert verify.data_integrity(numbers, less).first().lost == sum(r[0] == KG + "m1" for r in set(small_graph()))


def test_too_many_texts_of_one_hash_raise(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "p", str(i + 1), "literal", None, None) for i in range(700)], TRIPLE)
    with pytest.raises(PySparkException, match="too many texts"):
        terms.write(rows, str(tmp_path / "g"), ["p"], hash_bits=1)


def test_an_empty_graph(spark, tmp_path):
    _, numbers, known = stored(spark, [], str(tmp_path / "g"), 56)
    assert numbers.count() == 0 and known.table.count() == len(CONSTANTS)
    assert infer.property_chains(numbers, spark.createDataFrame(CHAINS, "first string, second string, inferred string"), known).count() == 0
