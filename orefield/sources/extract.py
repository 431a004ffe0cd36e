"""Entity, property and link tables from raw source tables (all columns text, ``nan`` and empty as null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import strings as S
from orefield.operators.resolve import append, first_per_key

# Source column, property name, unit, property type.
COMPUTED_PROPERTIES = [
    ("Band gap (eV)", "Band gap", "eV", "ComputationalProperty"),
    ("CO2 uptake at LP (mol/kg)", "CO2 uptake at low pressure", "mol/kg", "ComputationalProperty"),
    ("CO2 uptake at HP (mol/kg)", "CO2 uptake at high pressure", "mol/kg", "ComputationalProperty"),
    ("CH4 uptake at HP (mol/kg)", "CH4 uptake at high pressure", "mol/kg", "ComputationalProperty"),
    ("logKH_CO2", "log(KH) CO2", "dimensionless", "ComputationalProperty"),
    ("logKH_CH4", "log(KH) CH4", "dimensionless", "ComputationalProperty"),
    ("Largest included sphere diameter (A)", "Largest included sphere diameter", "Å", "StructuralProperty"),
    ("Total volumetric surface area (m^2/m^3)", "Total volumetric surface area", "m²/m³", "ComputationalProperty"),
    ("ASA [m^2/cm^3]", "Accessible surface area", "m²/cm³", "ComputationalProperty"),
    ("NASA [m^2/cm^3]", "Non-accessible surface area", "m²/cm³", "ComputationalProperty"),
    ("POAV [cm^3/g]", "Pore volume (accessible)", "cm³/g", "ComputationalProperty"),
    ("PONAV [cm^3/g]", "Pore volume (non-accessible)", "cm³/g", "ComputationalProperty"),
    ("POAVF", "Pore volume fraction (accessible)", "dimensionless", "ComputationalProperty"),
    ("PONAVF", "Pore volume fraction (non-accessible)", "dimensionless", "ComputationalProperty"),
    ("density [g/cm^3]", "Density", "g/cm³", "PhysicalProperty"),
    ("total_SA_gravimetric", "Total surface area (gravimetric)", "m²/g", "ComputationalProperty"),
    ("total_POV_volumetric", "Total pore volume (volumetric)", "cm³/cm³", "ComputationalProperty"),
    ("total_POV_gravimetric", "Total pore volume (gravimetric)", "cm³/g", "ComputationalProperty"),
    ("pure_CO2_kH", "CO2 Henry constant", "mol/(kg·Pa)", "ComputationalProperty"),
    ("pure_CO2_widomHOA", "CO2 Widom insertion energy", "kJ/mol", "ComputationalProperty"),
    ("pure_methane_kH", "CH4 Henry constant", "mol/(kg·Pa)", "ComputationalProperty"),
    ("pure_methane_widomHOA", "CH4 Widom insertion energy", "kJ/mol", "ComputationalProperty"),
    ("pure_uptake_methane_298.00_580000", "CH4 uptake at 298K, 58 bar", "mol/kg", "ComputationalProperty"),
    ("CH4DC", "CH4 delivery capacity", "cm³(STP)/cm³", "ComputationalProperty"),
    ("CH4HPSTP", "CH4 high pressure storage", "cm³(STP)/cm³", "ComputationalProperty"),
]
# The same for the second source.
MEASURED_PROPERTIES = [
    ("LCD (Å)", "Largest cavity diameter", "Å", "StructuralProperty"), ("PLD (Å)", "Pore limiting diameter", "Å", "StructuralProperty"),
    ("Density (kg/m3)", "Density", "kg/m³", "PhysicalProperty"), ("ASA (m2/g)", "Accessible surface area", "m²/g", "ComputationalProperty"),
    ("NASA (m2/g)", "Non-accessible surface area", "m²/g", "ComputationalProperty"), ("No. OMS", "Number of open metal sites", "count", "StructuralProperty"),
    ("Void fraction (POAV)", "Void fraction (accessible)", "dimensionless", "ComputationalProperty"), ("Void fraction (PONAV)", "Void fraction (non-accessible)", "dimensionless", "ComputationalProperty"),
]
# The same for the nested documents.
NESTED_PROPERTIES = [
    ("EgPBE", "Band gap (PBE)", "eV", "ComputationalProperty"), ("EgHLE17", "Band gap (HLE17)", "eV", "ComputationalProperty"), ("EgHSE06star", "Band gap (HSE06*)", "eV", "ComputationalProperty"),
    ("EgHSE06", "Band gap (HSE06)", "eV", "ComputationalProperty"), ("pld", "Pore limiting diameter", "Å", "ComputationalProperty"), ("lcd", "Largest cavity diameter", "Å", "ComputationalProperty"),
    ("density", "Density", "g/cm³", "PhysicalProperty"), ("volume", "Unit cell volume", "Å³", "StructuralProperty"), ("ASA", "Accessible surface area", "m²/g", "ComputationalProperty"),
    ("NASA", "Non-accessible surface area", "m²/g", "ComputationalProperty"), ("natoms", "Number of atoms", "count", "StructuralProperty"), ("netPBEMagmom", "Net magnetic moment (PBE)", "μB", "PhysicalProperty"),
    ("maxPBEChargeDDEC", "Max charge (DDEC)", "e", "ComputationalProperty"), ("maxPBEChargeCM5", "Max charge (CM5)", "e", "ComputationalProperty"), ("maxPBEMagmom", "Max magnetic moment (PBE)", "μB", "PhysicalProperty"),
    ("maxPBESpinDDEC", "Max spin (DDEC)", "dimensionless", "ComputationalProperty"), ("spacegroupNumber", "Space group number", "number", "StructuralProperty"),
]
# Amine code, name, type.
AMINES = [
    ("en", "Ethylenediamine", "1°/1°"), ("nmen", "N-Methylethylenediamine", "1°/2°"), ("een", "N-Ethylethylenediamine", "1°/2°"), ("ipen", "N-Isopropylethylenediamine", "1°/2°"),
    ("dmen", "N,N-Dimethylethylenediamine", "1°/3°"), ("deen", "N,N-Diethylethylenediamine", "1°/3°"), ("mmen", "Dimethylethylenediamine", "2°/2°"), ("eeen", "N,N’-Diethylethylenediamine", "2°/2°"),
    ("mden", "N,N,N’-Trimethylethylenediamine", "2°/3°"), ("tmen", "N,N,N’,N’-Tetramethylethylenediamine", "3°/3°"),
]
# Patterns of linker names in text, in lower case.
LINKER_PATTERNS = [
    r"\b(bdc|h2bdc|1,4-benzenedicarboxylate|terephthalate)\b", r"\b(btc|h3btc|1,3,5-benzenetricarboxylate|trimesate)\b", r"\b(ndc|h2ndc|2,6-naphthalenedicarboxylate)\b",
    r"\b(ina|isonicotinate|isonicotinic acid)\b", r"\b(pyridine|pyridyl)\b", r"\b(imidazolate|im)\b", r"\b(azolate|tetrazolate)\b",
]


def named(key: Column, names: Column) -> tuple[Column, Column]:
    """(canonical name, all names): the first of the names, else the key."""
    found = S.split_names(names)
    found = F.when(F.size(found) > 0, found).otherwise(F.array(key))
    return F.get(found, F.lit(0)), found


def materials(names: DataFrame, computed: DataFrame, key: str, order: str, text: dict[str, Column]) -> DataFrame:
    """Rows of ``names`` (key, names) with columns of the last row of each key in ``computed`` by ``order``."""
    last = computed.groupBy(key).agg(*[F.max_by(v, order).alias(n) for n, v in text.items()])
    canonical, every = named(F.col(key), F.col("names"))
    return names.filter(F.col(key).isNotNull()).select(key, canonical.alias("canonical_name"), every.alias("all_names")).join(last, key, "left")


def melt_properties(rows: DataFrame, key: str, spec: list[tuple[str, str, str, str]], zero_is_missing: bool = False) -> DataFrame:
    """(mof_id, property_id, property_name, units, property_type, value) of the columns of a spec that hold a number, in one pass."""
    cells = F.array(*[F.struct(S.property_id(F.col(key).cast("string"), F.lit(c)).alias("property_id"), F.lit(n).alias("property_name"), F.lit(u).alias("units"), F.lit(t).alias("property_type"), S.to_number(F.col(f"`{c}`").cast("string")).alias("value")) for c, n, u, t in spec if c in rows.columns])
    out = rows.select(F.col(key).cast("string").alias("mof_id"), F.explode(cells).alias("p")).select("mof_id", "p.*").filter("value is not null")
    return out.filter("value <> 0") if zero_is_missing else out


def long_properties(rows: DataFrame, key: str, name: str, value: str, units: str, conditions: str) -> DataFrame:
    """Properties that are rows already: those with a plain number; names of the crystal make them structural."""
    structural = F.lower(name).rlike("crystal system|space group|unit cell")
    kind = F.when(structural, "StructuralProperty").otherwise("PhysicalProperty")
    out = rows.select(F.col(key).cast("string").alias("mof_id"), F.col(name).alias("property_name"), kind.alias("property_type"), S.to_number(F.col(value).cast("string")).alias("value"), F.col(units).alias("units"), F.col(conditions).alias("conditions"))
    return out.filter("mof_id is not null and property_name is not null and value is not null")


def dimension_and_links(rows: DataFrame, key: str, entity: Column, attributes: dict[str, Column], order: str) -> tuple[DataFrame, DataFrame]:
    """(entities, links): the first row of each entity by ``order``, and which keys link to it."""
    found = rows.select(F.col(key).alias("mof_id"), entity.alias("entity_id"), F.col(order).alias("__order"), *[v.alias(n) for n, v in attributes.items()]).filter("entity_id is not null and mof_id is not null")
    return first_per_key(found.drop("mof_id"), "entity_id", ["__order"]).drop("__order"), found.select("mof_id", "entity_id").distinct()


def topology_of(text: Column) -> Column:
    """A topology's code, or null for text that names an error or none."""
    t = S.mofid_topology(text)
    return F.when(~F.upper(t).rlike("UNKNOWN|ERROR"), t)


def lattices(rows: DataFrame, key: str) -> DataFrame:
    """Lattice parameters a, b, c and angles, where any length is given and not zero."""
    numbers = {c: S.to_number(F.col(c).cast("string")) for c in ("a", "b", "c", "alpha", "beta", "gamma", "volume") if c in rows.columns}
    out = rows.select(F.col(key).alias("mof_id"), *[v.alias(n) for n, v in numbers.items()])
    return out.filter((F.coalesce("a", F.lit(0.0)) != 0) | (F.coalesce("b", F.lit(0.0)) != 0) | (F.coalesce("c", F.lit(0.0)) != 0))


def exploded_entities(rows: DataFrame, key: str, values: Column, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of an array column: one entity for each distinct text, with a hashed id."""
    links = rows.select(F.col(key).alias("mof_id"), F.explode(values).alias("name")).filter("name is not null and name <> ''").distinct()
    links = links.withColumn("entity_id", S.hash_id(prefix, F.col("name")))
    return links.select("entity_id", "name").distinct(), links.select("mof_id", "entity_id")


def metal_clusters(rows: DataFrame, key: str, elements: Column) -> tuple[DataFrame, DataFrame]:
    """(clusters, links): sorted elements, and which materials hold them."""
    found = rows.select(F.col(key).alias("mof_id"), F.array_sort(F.array_distinct(F.filter(elements, lambda x: (x != "") & (x != "0")))).alias("metal_elements")).filter(F.size("metal_elements") > 0)
    found = found.withColumn("cluster_id", S.cluster_key(F.col("metal_elements")))
    return found.select("cluster_id", "metal_elements").distinct(), found.select("mof_id", "cluster_id").distinct()


def capabilities(rows: DataFrame, key: str, application: str, keywords: list[tuple[str, str]]) -> DataFrame:
    """(capability_id, mof_id, capability_type): the first keyword that the text holds; a generic one if none."""
    text = F.col(application)
    kind = F.coalesce(*[F.when(F.lower(text).contains(k.lower()), c) for k, c in keywords], F.lit("Capability"))
    out = rows.filter(F.col(key).isNotNull() & text.isNotNull() & (text != "Not Provided")).select(F.col(key).cast("string").alias("mof_id"), kind.alias("capability_type"))
    return out.select(F.concat_ws("_", F.lit("CAP"), "mof_id", "capability_type").alias("capability_id"), "mof_id", "capability_type").distinct()


def processes(rows: DataFrame, key: str, method: Column, yield_percent: Column) -> DataFrame:
    return rows.select(F.concat(F.lit("SYNTH_"), F.col(key).cast("string")).alias("synthesis_id"), F.col(key).cast("string").alias("mof_id"), method.alias("method"), S.parse_number(yield_percent.cast("string")).alias("yield_percent")).filter("mof_id is not null")


def conditions(rows: DataFrame, key: str, temperature: Column, hours: Column, pressure: Column) -> DataFrame:
    """Conditions of which at least one is a number."""
    cells = {"temperature_c": temperature, "time_hours": hours, "pressure_bar": pressure}
    out = rows.select(F.concat(F.lit("COND_"), F.col(key).cast("string")).alias("condition_id"), F.concat(F.lit("SYNTH_"), F.col(key).cast("string")).alias("synthesis_id"), *[S.parse_number(v.cast("string")).alias(n) for n, v in cells.items()])
    return out.filter(F.coalesce(*cells).isNotNull())


def nested_properties(documents: DataFrame, key: Column, data: str, spec: list[tuple[str, str, str, str]] = NESTED_PROPERTIES) -> DataFrame:
    """Properties of nested documents whose values are numbers or records with a ``value``."""
    fields = {f.name: f.dataType.simpleString() for f in documents.select(f"{data}.*").schema}
    value = lambda c: F.col(f"{data}.{c}.value" if fields[c].startswith("struct") else f"{data}.{c}").cast("double")
    cells = F.array(*[F.struct(F.lit(n).alias("property_name"), F.lit(u).alias("units"), F.lit(t).alias("property_type"), value(c).alias("value")) for c, n, u, t in spec if c in fields])
    return documents.select(key.alias("mof_id"), F.explode(cells).alias("p")).select("mof_id", "p.*").filter("value is not null")


def functionalized(records: DataFrame, amines: DataFrame) -> DataFrame:
    """(func_mof_id, parent, code, amine, type, degree) of records (parent, code, name); unknown codes keep their code as name."""
    rows = records.filter(S.clean_null(F.col("name")).isNotNull()).join(F.broadcast(amines.toDF("code", "amine", "amine_type")), "code", "left")
    return rows.select(F.col("name").alias("func_mof_id"), "parent", "code", F.coalesce("amine", "code").alias("amine"), "amine_type", S.func_degree(F.col("name")).alias("degree"))


def binding_energies(records: DataFrame) -> DataFrame:
    """Binding energies that are numbers, of records (name, energies map<string,string>)."""
    rows = records.select(F.col("name").alias("mof_id"), F.explode("energies").alias("adsorbate", "text")).withColumn("value", S.to_number(F.col("text"))).filter("value is not null")
    return rows.select("mof_id", F.concat_ws("_", F.lit("PROP"), "mof_id", F.lit("binding"), "adsorbate").alias("property_id"), F.concat(F.lit("Binding Energy "), "adsorbate").alias("property_name"), "value", F.lit("eV").alias("units"))


def text_mentions(rows: DataFrame, key: str, text: Column, patterns: list[str] = LINKER_PATTERNS) -> DataFrame:
    """(mof_id, name): each name that the patterns find in a text, once per key."""
    low = F.lower(text)
    hits = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns]))
    return rows.select(F.col(key).alias("mof_id"), F.explode(F.array_distinct(F.coalesce(hits, F.array().cast("array<string>")))).alias("name")).distinct()


def consolidate(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of mentions (entity_id, name, smiles, source, mof_id, ord).

    Names and sources are united; the first SMILES counts; a name that is no placeholder beats one that is, then the first.
    """
    rank = F.struct(F.col("name").startswith("Linker_").alias("placeholder"), "ord", "name")
    entities = mentions.groupBy("entity_id").agg(
        F.min_by("name", rank).alias("canonical_name"), F.coalesce(F.min_by("smiles", F.when(F.col("smiles").isNotNull(), F.col("ord"))), F.lit("")).alias("smiles"),
        F.array_sort(F.collect_set("name")).alias("all_names"), F.array_sort(F.collect_set("source")).alias("data_sources"),
    )
    return entities, mentions.filter("mof_id is not null").select("mof_id", "entity_id").distinct()


def merge_syntheses(rows: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """One row per code of several files: the first number of temperature, time and yield by file; values of column groups in order, each once."""
    code = S.strip_suffixes(F.col("filename"))
    first = lambda c: F.min_by(S.parse_number(F.col(c)), F.when(S.parse_number(F.col(c)).isNotNull(), F.col("source_rank")))
    groups = {n: F.filter(F.array(*[S.norm_cid(F.col(c)) if n != "names" else F.col(c) for c in cs if c in rows.columns]), lambda x: x.isNotNull()) for n, cs in lists.items()}
    rows = rows.withColumns({"code": code} | {f"__{n}": v for n, v in groups.items()})
    merged = lambda n: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", f"__{n}"))), lambda x: x[f"__{n}"])))
    return rows.groupBy("code").agg(first("temperature_Celsius").alias("temperature_c"), first("time_h").alias("time_hours"), first("Yield_Percent").alias("yield_percent"), *[merged(n).alias(n) for n in lists])


def stability(rows: DataFrame, value: str, known: dict[str, DataFrame], prefix: str = "STAB_") -> tuple[DataFrame, DataFrame]:
    """(matched or new materials with their value and how they matched, new materials) of energy rows (mofid, mofkey, name).

    ``known``: label -> (key, mof_id); the labels ``mofid``, ``mofkey`` and ``name`` are tried in turn.
    """
    out, hits = rows.withColumn("value", S.to_number(F.col(value).cast("string"))), []
    for label, table in known.items():
        best = table.groupBy("key").agg(F.max("mof_id").alias(f"__{label}"))
        out = out.join(best, F.col(label) == F.col("key"), "left").drop("key")
        hits.append(label)
    method = F.coalesce(*[F.when(F.col(f"__{h}").isNotNull(), F.lit(h)) for h in hits], F.lit("new_entry"))
    source = F.coalesce(*[F.nullif(F.trim(F.col(h)), F.lit("")) for h in hits])
    out = out.withColumns({"match": method, "mof_id": F.coalesce(*[F.col(f"__{h}") for h in hits], S.hash_id(prefix, source))}).filter("mof_id is not null and value is not null")
    new = first_per_key(out.filter("match = 'new_entry'").select("mof_id", *hits), "mof_id", hits)
    return out.select("mof_id", "match", "value"), new.withColumn("components", S.mofid_components(F.col("mofid")))


def linked_components(new: DataFrame, linkers: DataFrame) -> DataFrame:
    """(mof_id, linker_ids) of new materials whose components are SMILES of known linkers (linker_id, smiles)."""
    parts = new.select("mof_id", F.explode("components").alias("smiles")).join(linkers, "smiles", "left")
    return parts.groupBy("mof_id").agg(F.array_sort(F.collect_set("linker_id")).alias("linker_ids"))


def union_sources(*tables: DataFrame) -> DataFrame:
    return append(*tables)
