"""Graph patterns over triples (graph, s, p, o, lang): what the remote endpoints would answer, evaluated as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import step
from . import graph as g

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
OBO_IN_OWL = "http://www.geneontology.org/formats/oboInOwl#"
OBO = "http://purl.obolibrary.org/obo/"
NCIT = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#"
DBO = "http://dbpedia.org/ontology/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE, SUB, LABEL = f"{RDF}type", f"{RDFS}subClassOf", f"{RDFS}label"


def from_graph(triples: DataFrame, name: str | None) -> DataFrame:
    return triples if name is None else triples.where(F.col("graph") == name)


def pattern(triples: DataFrame, s: str = "s", p: str | None = None, o: str | Column = "o") -> DataFrame:
    """Bindings of one triple pattern: variables are names, a predicate is fixed, an object Column is a constant."""
    rows = triples if p is None else triples.where(F.col("p") == p)
    out = [F.col("s").alias(s)]
    if p is None:
        out.append(F.col("p"))
    if isinstance(o, Column):
        rows = rows.where(F.col("o") == o)
    else:
        out.append(F.col("o").alias(o))
    return rows.select(*out)


def optional(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left")


def exists(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """A flag whether ``right`` has a match."""
    return left.join(right.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def not_exists(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def values(spark, name: str, items: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], f"{name} string")


def group_concat(rows: DataFrame, by: list[str], value: str, name: str, separator: str = " | ") -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias(name))


def with_language(rows: DataFrame, lang: str) -> DataFrame:
    return rows.where(F.col("lang") == lang)


def hierarchy_edges(triples: DataFrame) -> DataFrame:
    return pattern(triples, "child", SUB, "parent").select("parent", "child")


def descendants(triples: DataFrame, start: DataFrame, include_self: bool = False) -> DataFrame:
    return g.closure(hierarchy_edges(triples), start, True, include_self)


def ancestors(triples: DataFrame, start: DataFrame, include_self: bool = False) -> DataFrame:
    return g.closure(hierarchy_edges(triples), start, False, include_self)


def _starts(concepts: DataFrame, prefix: str) -> DataFrame:
    return concepts.select("concept_code", F.concat(F.lit(prefix), "concept_code").alias("id")).distinct()


def _listed(rows: DataFrame, term: str, order: list[str], limit: int, k: int) -> DataFrame:
    """concept_code -> terms: lower case, the first k different of the first ``limit`` rows by ``order``.

    Only ``limit`` rows of a concept are ever brought together; tasks cut theirs before the shuffle.
    """
    ranked = rows.select("concept_code", F.struct(*order, F.lower(term).alias("__term")).alias("__row"))
    ranked = ranked.withColumn("__nth", F.row_number().over(Window.partitionBy("concept_code").orderBy("__row"))).where(F.col("__nth") <= limit)
    first = F.array_sort(F.collect_list("__row"))
    return ranked.groupBy("concept_code").agg(F.slice(F.array_distinct(F.transform(first, lambda x: x["__term"])), 1, k).alias("terms"))


def _reached(edges: DataFrame, start: DataFrame, items: DataFrame, limit: int, k: int, down: bool, include_self: bool = False) -> DataFrame:
    """concept_code -> terms: lower case, the first k different labels of the least ``limit`` items that the concept reaches."""
    found = g.least_reachable(edges, start, items, limit, down, include_self).withColumnRenamed("start", "id")
    terms = F.slice(F.array_distinct(F.transform("items", lambda x: F.lower(x["label"]))), 1, k)
    return start.join(found, "id").select("concept_code", terms.alias("terms"))


def _assemble(concepts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    out = concepts.select("concept_code").distinct()
    for name in ("parents", "children", "synonyms", "labels"):
        if name in parts:
            out = out.join(parts[name].withColumnRenamed("terms", name), "concept_code", "left").withColumn(name, F.coalesce(name, none))
        else:
            out = out.withColumn(name, none)
    return out


def ncit_terms(triples: DataFrame, concepts: DataFrame, k: int = 3, graph: str | None = None) -> DataFrame:
    """Labels of all super- and subclasses, annotation values with their labelled properties, and the own label."""
    t = from_graph(triples, graph)
    start = _starts(concepts, NCIT)
    label = pattern(t, "id", LABEL, "label")
    out = {}
    items = step(label.select("id", F.struct("label", "id").alias("item")), "items")
    for name, down in (("children", True), ("parents", False)):
        out[name] = _reached(hierarchy_edges(t), start, items, 500, k, down)
    props = pattern(t, "prop", TYPE, F.lit(f"{OWL}AnnotationProperty")).join(pattern(t, "prop", LABEL, "prop_label"), "prop")
    rows = start.join(t.select(F.col("s").alias("id"), F.col("p").alias("prop"), F.col("o").alias("prop_value")), "id").join(props, "prop")
    out["synonyms"] = _listed(rows, "prop_value", ["prop_label", "prop_value"], 100, k)
    out["labels"] = _listed(start.join(label, "id"), "label", ["label"], 500, k)
    return _assemble(concepts, out)


def ncit_annotations(triples: DataFrame, concepts: DataFrame, graph: str | None = None) -> DataFrame:
    """concept_code, prop_label, prop_value and the annotations of that statement (label=value, joined by ' | ')."""
    t = from_graph(triples, graph)
    start = _starts(concepts, NCIT)
    props = pattern(t, "prop", TYPE, F.lit(f"{OWL}AnnotationProperty")).join(pattern(t, "prop", LABEL, "prop_label"), "prop")
    rows = start.join(t.select(F.col("s").alias("id"), F.col("p").alias("prop"), F.col("o").alias("prop_value")), "id").join(props, "prop").distinct()
    axiom = pattern(t, "an", TYPE, F.lit(f"{OWL}Axiom"))
    for p, name in (("annotatedSource", "id"), ("annotatedProperty", "prop"), ("annotatedTarget", "prop_value")):
        axiom = axiom.join(pattern(t, "an", f"{OWL}{p}", name), "an")
    notes = t.select(F.col("s").alias("an"), F.col("p").alias("annotation"), F.col("o").alias("annot_value")).join(pattern(t, "annotation", LABEL, "annotation_label"), "annotation")
    notes = axiom.join(notes, "an").withColumn("annot", F.concat("annotation_label", F.lit("="), "annot_value"))
    grouped = group_concat(notes, ["id", "an", "prop", "prop_value"], "annot", "annotations").drop("an").distinct()
    return optional(rows, grouped, ["id", "prop", "prop_value"]).select("concept_code", "prop_label", "prop_value", "annotations").distinct()


def doid_terms(triples: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """Super- and subclasses with a cross reference (the concept itself included), exact synonyms, the own label."""
    t = triples
    start = _starts(concepts, f"{OBO}DOID_")
    label, deprecated = pattern(t, "id", LABEL, "label"), pattern(t, "id", f"{OWL}deprecated", F.lit("true"))
    xref = pattern(t, "id", f"{OBO_IN_OWL}hasDbXref", "xref").where(F.col("xref").rlike("^(ICD9|ICD10|SNOMED)"))
    number = pattern(t, "id", f"{OBO_IN_OWL}id", "number")
    out = {}
    rows = not_exists(label.join(number, "id").join(xref, "id"), deprecated, ["id"])
    items = step(rows.select("id", F.struct("number", "label", "xref", "id").alias("item")), "items")
    for name, down in (("children", True), ("parents", False)):
        out[name] = _reached(hierarchy_edges(t), start, items, 20, k, down, include_self=True)
    out["synonyms"] = _listed(doid_synonyms(t, concepts), "exact_synonym", ["number", "exact_synonym"], 20, k)
    out["labels"] = _listed(start.join(label, "id"), "label", ["label"], 20, k)
    return _assemble(concepts, out)


def doid_synonyms(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_code, number, label, exact_synonym, syn_is_acronym of classes that are not deprecated."""
    t = triples
    ids = concepts.select("concept_code", F.concat(F.lit("DOID:"), "concept_code").alias("number")).distinct()
    rows = pattern(t, "id", TYPE, F.lit(f"{OWL}Class")).join(pattern(t, "id", f"{OBO_IN_OWL}hasOBONamespace", F.lit("disease_ontology")), "id")
    rows = rows.join(pattern(t, "id", f"{OBO_IN_OWL}id", "number"), "id").join(ids, "number").join(pattern(t, "id", LABEL, "label"), "id")
    rows = rows.join(pattern(t, "id", f"{OBO_IN_OWL}hasExactSynonym", "exact_synonym"), "id")
    axiom = pattern(t, "an", TYPE, F.lit(f"{OWL}Axiom")).join(pattern(t, "an", f"{OWL}annotatedProperty", F.lit(f"{OBO_IN_OWL}hasExactSynonym")), "an")
    axiom = axiom.join(pattern(t, "an", f"{OBO_IN_OWL}hasSynonymType", F.lit(f"{OBO}OMO_0003012")), "an")
    axiom = axiom.join(pattern(t, "an", f"{OWL}annotatedSource", "id"), "an").join(pattern(t, "an", f"{OWL}annotatedTarget", "exact_synonym"), "an")
    rows = exists(rows, axiom, ["id", "exact_synonym"], "syn_is_acronym")
    return not_exists(rows, pattern(t, "id", f"{OWL}deprecated", F.lit("true")), ["id"]).drop("id")


def dbpedia_terms(triples: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """Types as parents, instances as children, English alternative labels of instances as synonyms, the own ones as labels."""
    t = triples
    start = _starts(concepts, DBO)
    alt = t.where((F.col("p") == f"{SKOS}altLabel") & (F.col("lang") == "en")).select(F.col("s").alias("id"), F.col("o").alias("alt"))
    types = t.where(F.col("p") == TYPE)
    parents = start.join(types.select(F.col("s").alias("id"), F.col("o").alias("object")), "id")
    children = start.join(types.select(F.col("o").alias("id"), F.col("s").alias("object")), "id")
    synonyms = children.select("concept_code", F.col("object").alias("id")).join(alt, "id").distinct()
    return _assemble(
        concepts,
        {
            "parents": _listed(parents, "object", ["object"], 10, k), "children": _listed(children, "object", ["object"], 10, k),
            "synonyms": _listed(synonyms, "alt", ["id", "alt"], 10, k), "labels": _listed(start.join(alt, "id").distinct(), "alt", ["alt"], 10, k),
        },
    )
