"""Terms of concepts from SPARQL endpoints, asked for in blocks of concepts and read page by page."""

from __future__ import annotations

import re
import time
import urllib.error
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triples import DBO, NCIT, OBO, OBO_IN_OWL, OWL, RDFS, SKOS
from ..schemas import TERMS
from .remote import SparqlEndpoint

#: Public endpoints, and the graph that one of them keeps its triples in.
ENDPOINTS = {"ncit": "https://shared.semantics.cancer.gov/sparql", "doid": "https://sparql.disease-ontology.org/", "dbpedia": "http://dbpedia.org/sparql"}
NCIT_GRAPH = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.rdf"

PREFIXES = {"rdfs": RDFS, "owl": OWL, "oio": OBO_IN_OWL, "obo": OBO, "skos": SKOS}
PLAIN = re.compile(r"[A-Za-z0-9](?:[\w.-]*[\w-])?", re.ASCII)


@dataclass(frozen=True)
class Relation:
    """What binds ?value to ?start, the variables that order a concept's rows, how many of these count."""

    body: str
    order: tuple[str, ...]
    limit: int


@dataclass(frozen=True)
class Source:
    """Concepts are ``prefix`` and their code; each of the four lists is a relation."""

    prefix: str
    relations: dict[str, Relation]
    graph: str | None = None
    prefixes: dict[str, str] = field(default_factory=lambda: PREFIXES)

    def text(self, name: str, codes: list[str], page: int, offset: int) -> str:
        """The query of one relation for a block of concepts; its rows have one order, so pages meet without gaps."""
        r = self.relations[name]
        variables = dict.fromkeys(["start", *r.order, "value"])
        head = [f"PREFIX {k}: <{v}>" for k, v in self.prefixes.items()]
        names = " ".join(f"?{v}" for v in variables)
        starts = " ".join(f"<{self.prefix}{c}>" for c in codes)
        graph = [f"FROM <{self.graph}>"] if self.graph else []
        return "\n".join([*head, f"SELECT DISTINCT {names}", *graph, f"WHERE {{ VALUES ?start {{ {starts} }} {r.body} }}", f"ORDER BY {names}", f"LIMIT {page} OFFSET {offset}"])


_COUNTED = '?x rdfs:label ?value ; oio:id ?number ; oio:hasDbXref ?xref . FILTER REGEX(?xref, "^(ICD9|ICD10|SNOMED)") FILTER NOT EXISTS { ?x owl:deprecated true }'
SOURCES = {
    "ncit": Source(
        NCIT,
        {
            "parents": Relation("?start rdfs:subClassOf+ ?x . ?x rdfs:label ?value .", ("value", "x"), 500),
            "children": Relation("?x rdfs:subClassOf+ ?start . ?x rdfs:label ?value .", ("value", "x"), 500),
            "synonyms": Relation("?start ?property ?value . ?property a owl:AnnotationProperty ; rdfs:label ?name .", ("name", "value"), 100),
            "labels": Relation("?start rdfs:label ?value .", ("value",), 500),
        },
        NCIT_GRAPH,
    ),
    "doid": Source(
        f"{OBO}DOID_",
        {
            "parents": Relation(f"?start rdfs:subClassOf* ?x . {_COUNTED}", ("number", "value", "xref", "x"), 20),
            "children": Relation(f"?x rdfs:subClassOf* ?start . {_COUNTED}", ("number", "value", "xref", "x"), 20),
            "synonyms": Relation(
                '?start a owl:Class ; oio:hasOBONamespace "disease_ontology" ; oio:id ?number ; rdfs:label ?label ; oio:hasExactSynonym ?value . FILTER NOT EXISTS { ?start owl:deprecated true }',
                ("number", "value"),
                20,
            ),
            "labels": Relation("?start rdfs:label ?value .", ("value",), 20),
        },
    ),
    "dbpedia": Source(
        DBO,
        {
            "parents": Relation("?start a ?value .", ("value",), 10),
            "children": Relation("?value a ?start .", ("value",), 10),
            "synonyms": Relation('?x a ?start ; skos:altLabel ?value . FILTER (LANG(?value) = "en")', ("x", "value"), 10),
            "labels": Relation('?start skos:altLabel ?value . FILTER (LANG(?value) = "en")', ("value",), 10),
        },
    ),
}


class _Asked:
    """Queries of one task: pages, tries and its budget of requests."""

    def __init__(self, source: Source, endpoint: SparqlEndpoint, page: int, budget: int, tries: int, wait: float):
        self.source, self.endpoint, self.page, self.left, self.tries, self.wait = source, endpoint, page, budget, tries, wait

    def bindings(self, query: str) -> list[dict]:
        for tried in range(1, self.tries + 1):
            if not self.left:
                raise RuntimeError("the task's requests are spent")
            self.left -= 1
            try:
                return self.endpoint.ask(query)["results"]["bindings"]
            except (urllib.error.URLError, TimeoutError) as e:
                if tried == self.tries or isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500:
                    raise
                time.sleep(self.wait * 2 ** (tried - 1))
        raise ValueError("tries must be 1 at least")

    def terms(self, name: str, codes: list[str], k: int) -> dict[str, list[str]]:
        """The first k different values, in lower case, of the rows that count of each concept; one page is held at a time."""
        relation, out, seen = self.source.relations[name], {c: {} for c in codes}, dict.fromkeys(codes, 0)
        for offset in range(0, 1 << 62, self.page):
            rows = self.bindings(self.source.text(name, codes, self.page, offset))
            for row in rows:
                code = row["start"]["value"].removeprefix(self.source.prefix)
                if code in seen and seen[code] < relation.limit:
                    seen[code] += 1
                    if len(out[code]) < k:
                        out[code].setdefault(row["value"]["value"].lower())
            if len(rows) < self.page:
                return {c: list(v) for c, v in out.items()}
        raise AssertionError


def fetch(concepts: DataFrame, source: Source, endpoint: SparqlEndpoint, k: int = 3, block: int = 50, page: int = 10_000, tasks: int = 4, budget: int = 100_000, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """concept_code, parents, children, synonyms, labels, error of concepts (concept_code).

    ``tasks`` ask side by side, each for ``block`` concepts a request, a request a list and page, ``budget`` requests at most. A block
    that fails has empty lists and its error, as has a code that is no plain name (it is never put into a query); null is left out.
    """

    def answered(asked: _Asked, codes: list[str]) -> list[tuple]:
        try:
            lists = [asked.terms(name, codes, k) for name in TERMS]
            return [(c, *(found[c] for found in lists), None) for c in codes]
        except Exception as e:  # one block's failure is kept with its rows
            return [(c, [], [], [], [], f"{type(e).__name__}: {e}") for c in codes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(source, endpoint, page, budget, tries, wait)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), *[pa.list_(pa.string()) for _ in TERMS], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["concept_code", *TERMS, "error"])

        held: list[str] = []
        for batch in batches:
            for code in batch.column(0).to_pylist():
                if PLAIN.fullmatch(code):
                    held.append(code)
                else:
                    yield table([(code, [], [], [], [], "not a plain code")])
                if len(held) == block:
                    yield table(answered(asked, held))
                    held = []
        if held:
            yield table(answered(asked, held))

    one = concepts.select("concept_code").where(F.col("concept_code").isNotNull()).distinct()
    lists = ", ".join(f"{n} array<string>" for n in TERMS)
    return one.repartition(tasks).mapInArrow(work, f"concept_code string, {lists}, error string")


def endpoint_of(name: str) -> tuple[Source, SparqlEndpoint]:
    """``name`` or ``name=address``."""
    known, _, url = name.partition("=")
    if known not in SOURCES:
        raise ValueError(f"unknown source: {known}")
    return SOURCES[known], SparqlEndpoint(url or ENDPOINTS[known])
