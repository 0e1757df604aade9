"""Knowledge about concepts: dictionaries, hierarchy, concept edges, and the dispatcher over them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import TERMS
from ..storage import step

DICTIONARY_OPTIONS = ("omim", "ordo", "matonto", "mi2", "envo", "sweet", "mi", "emmo", "yago", "wikidata", "mouse", "human")
TRIPLE_OPTIONS = ("ncit", "doid", "dbpedia")
TOP_DICTIONARY, TOP_TRIPLES, TOP_EDGES = 3, 3, 5


def empty_terms() -> list:
    return [F.expr("cast(array() as array<string>)").alias(k) for k in TERMS]


def dictionary_terms(concepts: DataFrame, dictionary: DataFrame, k: int = TOP_DICTIONARY) -> DataFrame:
    """concept_code with its four lists: parents and children as terms of their URIs, the first k different of each."""
    both = concepts.select("concept_code").distinct().join(dictionary, "concept_code", "left")
    out = []
    for name in TERMS:
        values = F.coalesce(F.col(name), F.expr("cast(array() as array<string>)"))
        if name in ("parents", "children"):
            values = text.strip_path(text.clean_uris(values))
        out.append(text.first_distinct(values, k).alias(name))
    return both.select("concept_code", *out)


def parent_child_maps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parents) and (id, children), each list sorted and distinct."""
    parents = edges.distinct().groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    children = edges.distinct().groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    return parents, children


def ontology_terms(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    parents, children = parent_child_maps(edges)
    none = F.expr("cast(array() as array<string>)")
    both = concepts.select("concept_code").distinct().join(parents.withColumnRenamed("id", "concept_code"), "concept_code", "left")
    both = both.join(children.withColumnRenamed("id", "concept_code"), "concept_code", "left")
    return both.select("concept_code", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"), none.alias("synonyms"), none.alias("labels"))


def best_terms(scored: DataFrame, keys: list[str], k: int = TOP_EDGES) -> DataFrame:
    """Of rows keys, term, weight, seq: the k terms of greatest weight, ties by first appearance, as a list column ``terms``."""
    one = scored.groupBy(*keys, "term").agg(F.max(F.greatest("weight", F.lit(0.0))).alias("weight"), F.min("seq").alias("seq"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "seq", "term"))
    top = one.withColumn("nth", nth).where(F.col("nth") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("terms"))


def edge_terms(concepts: DataFrame, edges: DataFrame, lexicon: DataFrame, similarity: Callable[[DataFrame], DataFrame], k: int = TOP_EDGES) -> DataFrame:
    """Concept-net source. edges: concept, start_label, end_label, rel_label, weight, seq; concepts must be lexicon words.

    ``similarity`` adds sim_start and sim_end, the likeness of either end to the concept.
    """
    known = concepts.select("concept_code").distinct().join(lexicon.select(F.col("word").alias("concept_code")).distinct(), "concept_code", "left_semi")
    rows = edges.join(known.select(F.col("concept_code").alias("concept")), "concept")
    rows = rows.withColumns({c: F.lower(c) for c in ("start_label", "end_label", "rel_label")}).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = similarity(rows).withColumn("term", text.nearer_term(F.col("start_label"), F.col("end_label"), F.col("sim_start"), F.col("sim_end")))
    rows = rows.withColumn("kind", text.relation_kind(F.col("rel_label")))
    lists = best_terms(rows, ["concept", "kind"], k).groupBy("concept").pivot("kind", ["parent", "child", "synonym"]).agg(F.first("terms"))
    none = F.expr("cast(array() as array<string>)")
    both = concepts.select("concept_code").distinct().join(known.withColumn("__word", F.lit(True)), "concept_code", "left")
    both = both.join(lists, both["concept_code"] == lists["concept"], "left")
    return both.select(
        "concept_code", F.coalesce("parent", none).alias("parents"), F.coalesce("child", none).alias("children"), F.coalesce("synonym", none).alias("synonyms"),
        F.when(F.col("__word"), F.array("concept_code")).otherwise(none).alias("labels"),
    )


class Sources:
    """What each option reads: dictionaries by name, a hierarchy, triples, concept edges; any of them may be missing."""

    def __init__(self, dictionaries: dict[str, DataFrame] | None = None, edges: DataFrame | None = None, triples: dict[str, Callable[[DataFrame], DataFrame]] | None = None, concept_net: Callable[[DataFrame], DataFrame] | None = None):
        self.dictionaries, self.edges, self.triples, self.concept_net = dictionaries or {}, edges, triples or {}, concept_net

    def fetch(self, option: str, concepts: DataFrame) -> DataFrame | None:
        """None for an option that is unknown: it is skipped with a warning, as is one whose source is not at hand."""
        if option in DICTIONARY_OPTIONS and option in self.dictionaries:
            return dictionary_terms(concepts, self.dictionaries[option])
        if option in TRIPLE_OPTIONS and option in self.triples:
            return self.triples[option](concepts)
        if option == "ontology" and self.edges is not None:
            return ontology_terms(concepts, self.edges)
        if option == "conceptnet" and self.concept_net is not None:
            return self.concept_net(concepts)
        warnings.warn(f"knowledge option {option!r} has no source and is skipped", stacklevel=2)
        return None


def query(concepts: DataFrame, options: list[str], sources: Sources) -> DataFrame:
    """concept_code, its four lists over all options in their order (first appearance kept), source_error (skipped options).

    One left join an option, whatever the number of concepts.
    """
    out = concepts.select("concept_code").distinct()
    parts, missing = [], []
    for i, option in enumerate(options):
        try:
            found = sources.fetch(option, concepts)
            if found is not None and option not in DICTIONARY_OPTIONS:
                found = step(found, "knowledge")  # it fails here, if at all, and alone
        except Exception as e:  # a source that fails is skipped, and said so
            found = None
            warnings.warn(f"knowledge option {option!r} failed: {e}", stacklevel=2)
        if found is None:
            missing.append(option)
            continue
        out = out.join(found.select("concept_code", *[F.col(k).alias(f"__{k}{i}") for k in TERMS]), "concept_code", "left")
        parts.append(i)
    none = F.expr("cast(array() as array<string>)")
    lists = [F.array_distinct(F.concat(none, *[F.coalesce(F.col(f"__{k}{i}"), none) for i in parts])).alias(k) for k in TERMS]
    return out.select("concept_code", *lists, F.lit(",".join(missing)).alias("source_error"))


def enrich(alignment: DataFrame, options: list[str], sources: Sources) -> DataFrame:
    """The metadata of every node of both sides, looked up as one set."""
    codes = alignment.select(F.col("src.code").alias("concept_code")).unionByName(alignment.select(F.col("tgt.code").alias("concept_code")))
    return query(codes, options, sources)


def with_metadata(alignment: DataFrame, metadata: DataFrame) -> DataFrame:
    """Both sides' metadata beside the pair: left joins, empty lists where there is none."""
    for side in ("src", "tgt"):
        own = metadata.select(F.col("concept_code").alias(f"__{side}"), F.struct(*TERMS).alias(f"{side}_meta"))
        alignment = alignment.withColumn(f"__{side}", F.col(f"{side}.code")).join(own, f"__{side}", "left").drop(f"__{side}")
        alignment = alignment.withColumn(f"{side}_meta", F.coalesce(f"{side}_meta", F.struct(*empty_terms())))
    return alignment
