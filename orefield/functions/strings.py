"""Column functions for names, ids, formulas and URIs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orefield.schema import KG, ONTO


def clean_null(s: Column) -> Column:
    """Trimmed text; empty text and ``nan`` are null."""
    t = F.trim(s)
    return F.when((t != "") & (t != "nan"), t)


def split_names(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"<\|>"), lambda x: F.trim(x)), lambda x: x != "")


def parse_number(s: Column) -> Column:
    """A number after any signs of being approximate, or null."""
    return F.regexp_replace(F.trim(s), "^[∼~><≈≤≥]+", "").try_cast("double")


def mofid_topology(s: Column) -> Column:
    found = F.regexp_extract(s, r"MOFid-v1\.([^.]+)\.", 1)
    return F.when(~found.isin("", "UNKNOWN", "ERROR"), found)


def strip_suffixes(s: Column) -> Column:
    return F.regexp_replace(s, "(?i)(_clean|_charged)+$", "")


def norm_cid(s: Column) -> Column:
    return s.try_cast("double").cast("long").cast("string")


def property_id(code: Column, column: Column) -> Column:
    return F.concat(F.lit("PROP_"), code, F.lit("_"), F.translate(column, " ()/[]^", "_"))


def cluster_key(elements: Column) -> Column:
    return F.concat(F.lit("CLUSTER_"), F.array_join(F.array_sort(F.array_distinct(elements)), "_"))


def func_degree(name: Column) -> Column:
    inner = F.regexp_extract(name, r"_(\d+\.\d+)_", 1).try_cast("double")
    return F.coalesce(inner, F.regexp_extract(name, r"_(\d+)$", 1).try_cast("double"))


# How a space group's symbol starts, its crystal system.
CRYSTAL_RULES = [
    ("(P-1|P1)$", "triclinic"), ("C2|P2", "monoclinic"), ("P3|R3", "trigonal"), ("P4|I4", "tetragonal"), ("P6", "hexagonal"),
    ("(Fm-3m|Im-3m|Pm-3m|Fd-3m|Ia-3d)$", "cubic"), ("(?i).*orthorhombic", "orthorhombic"),
]


def crystal_system(symbol: Column) -> Column:
    """The system of the first rule that a space group's symbol fits, or null."""
    s = F.trim(symbol)
    return F.coalesce(*[F.when(s.rlike(f"^({rule})"), system) for rule, system in CRYSTAL_RULES])


def hash_id(prefix: str, s: Column, n: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(s), 1, n)))


def norm_smiles(s: Column) -> Column:
    """The first entry of a list literal, else the trimmed text."""
    return F.when(F.trim(s).startswith("["), F.regexp_extract(s, r"^\s*\[\s*['\"]([^'\"]*)['\"]", 1)).otherwise(F.trim(s))


def clean_name(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def mofid_components(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.split(s, " ")[0], r"\."), lambda x: x != ""))


def extract_doi(s: Column) -> Column:
    at = F.instr(s, "10.")
    return F.when(at > 0, F.replace(F.substr(s, at), F.lit("%2F"), F.lit("/")))


def sanitize_uri(s: Column) -> Column:
    return F.regexp_replace(s.cast("string"), r"[^A-Za-z0-9_\-.]", "_")


def mint(kind: str, key: Column) -> Column:
    """The URI of a node: its kind's prefix and its sanitized key."""
    return F.concat(F.lit(f"{KG}{kind}_"), sanitize_uri(key))


#: Kinds of nodes, and the prefixes of their URIs.
MINTED = {
    "material": "MOF", "linker": "Linker", "metal_cluster": "MetalCluster", "topology": "Topology", "space_group": "SpaceGroup", "crystal_system": "CrystalSystem", "property": "Property", "synthesis": "Synthesis",
    "condition": "Condition", "abstract": "Abstract", "capability": "CAP", "derivative": "FuncMOF", "functionalization": "Functionalization", "solvent": "Solvent", "chemical": "Chemical", "lattice": "Lattice",
}


def node_uri(kind: str, key: Column) -> Column:
    """The URI of a node of one of the kinds in MINTED; a key that carries the prefix already gets no second one."""
    prefix = MINTED[kind] + "_"
    return mint(MINTED[kind], F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1))).otherwise(key))


def term(name: str) -> Column:
    return F.lit(ONTO + name)


def local_name(uri: Column) -> Column:
    return F.when(F.instr(uri, "#") > 0, F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def predicate_label(uri: Column) -> Column:
    return F.regexp_replace(local_name(uri), "(?<!^)(?=[A-Z])", " ")


#: Prefix of a local name, kind of node.
ENTITY_KINDS = [
    ("FuncMOF_", "Functionalized"), ("MOF_", "MOF"), ("Linker_", "Linker"), ("MetalCluster_", "Metal"), ("Topology_", "Topology"), ("SpaceGroup_", "SpaceGroup"),
    ("Property_", "Property"), ("Synthesis_", "Synthesis"), ("Condition_", "Condition"), ("Solvent_", "Solvent"),
]


def entity_type(uri: Column) -> Column:
    name, out = local_name(uri), None
    for prefix, kind in ENTITY_KINDS:
        out = (F if out is None else out).when(name.startswith(prefix), kind)
    return out.otherwise("Other")


def mof_family(uri: Column) -> Column:
    """The parent's code, which a parent and its derivatives share."""
    return F.split(F.regexp_replace(local_name(uri), "^(Func)?MOF_", ""), "_")[0]


def source_class(uri: Column) -> Column:
    name = local_name(uri)
    return F.when(name.startswith("FuncMOF_"), "Functionalized").when(name.startswith("MOF_STAB"), "STAB").when(name.startswith("MOF_qmof"), "qmof").otherwise("CSD")


def parent_uri(func_uri: Column) -> Column:
    return F.concat(F.lit(KG + "MOF_"), mof_family(func_uri))


def amine_code(func_uri: Column) -> Column:
    return F.get(F.split(F.regexp_replace(local_name(func_uri), "^FuncMOF_", ""), "_"), F.lit(1))


def func_to_prop_uri(uri: Column) -> Column:
    return F.replace(uri, F.lit("FuncMOF_"), F.lit("MOF_"))


def tokens(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")


def primary_metal(s: Column) -> Column:
    found = F.split(F.trim(s), r"[;,\s]+")
    return F.coalesce(F.get(F.filter(found, lambda x: F.char_length(x) <= 2), F.lit(0)), F.get(found, F.lit(0)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def formula_fractions(formula: Column, elements: list[str]) -> Column:
    """The share of each of ``elements`` among all atoms of a formula."""
    names = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(2)), lambda c: F.coalesce(c.try_cast("double"), F.lit(1.0)))
    pairs = F.zip_with(names, counts, lambda e, n: F.struct(e.alias("e"), n.alias("n")))
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    own = lambda x, e: F.aggregate(F.filter(x["pairs"], lambda y: y["e"] == e), F.lit(0.0), lambda a, y: a + y["n"])
    return once(F.struct(pairs.alias("pairs"), total.alias("total")), lambda x: F.array(*[F.when(x["total"] > 0, own(x, e) / x["total"]).otherwise(0.0) for e in elements]))


def ngram_features(s: Column, n_bits: int = 32, n: int = 3) -> Column:
    """Mean over ``;``-separated parts of character n-gram bits, by the first 32 bits of an n-gram's md5; zeros where there is no part."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - n + 1, F.lit(1))), lambda i: F.pmod(F.conv(F.substring(F.md5(F.substr(t, i, F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n_bits)))
    share = lambda parts, b: F.coalesce(F.size(F.filter(parts, lambda g: F.array_contains(g, b.cast("long")))) / F.nullif(F.size(parts), F.lit(0)), F.lit(0.0))
    return once(F.transform(tokens(s), grams), lambda parts: F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda b: share(parts, b)))


def to_number(s: Column) -> Column:
    """A finite number, or null."""
    x = s.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_name(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "_")


def names_match(a: Column, b: Column) -> Column:
    """Either name holds the other, whatever the case."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)
