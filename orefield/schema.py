"""Names and column types of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

KG = "http://example.org/kg#"
ONTO = "http://example.org/onto#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind", "datatype", "lang")])
TRIPLE_COLUMNS = TRIPLE.fieldNames()

# Predicate, inverse.
INVERSES = [
    ("hasLinker", "usedInMOF"), ("hasMetalNode", "isComponentOf"), ("hasSpaceGroup", "hasSpaceGroupOwner"), ("hasCrystalSystem", "hasCrystalSystemOwner"),
    ("hasLatticeParameters", "hasLatticeParametersOwner"), ("hasPhysicalProperty", "hasPhysicalPropertyOwner"), ("hasStructuralProperty", "hasStructuralPropertyOwner"),
    ("hasComputationalProperty", "hasComputationalPropertyOwner"), ("hasChemicalProperty", "hasChemicalPropertyOwner"), ("hasSynthesisProcess", "hasMOF"),
    ("hasAbstract", "describedInAbstract"), ("usesSolvent", "usedInSynthesis"), ("usesAdditive", "usedAsAdditiveIn"),
]
# First predicate, second predicate, inferred predicate.
CHAINS = [
    ("hasSynthesisProcess", "usesSolvent", "directlyUsesSolvent"),
    ("hasSynthesisProcess", "hasCondition", "hasSynthesisCondition"),
    ("hasSynthesisProcess", "hasProcedure", "hasSynthesisProcedure"),
]
# Classes that no node may share.
DISJOINT = [("ExperimentalMOF", "HypotheticalMOF"), ("MOF", "Linker"), ("MOF", "MetalCluster"), ("Linker", "MetalCluster"), ("MOF", "Topology")]
PROPERTY_TYPES = ["PhysicalProperty", "StructuralProperty", "ComputationalProperty", "ChemicalProperty"]
NAME_PREDICATES = ["hasName", "hasLinkerName", "hasTopologyName", "hasPropertyName", "hasSolventName"]
