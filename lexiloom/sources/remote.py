"""Remote knowledge behind providers: concept edges over HTTP, bindings of SPARQL endpoints.

Providers go to the workers and are asked once a concept. Tests and offline runs give their own; nothing here is called
unless asked for.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_env(name: str) -> str:
    """An environment variable that must be set."""
    value = os.environ.get(name)
    if not value:
        raise ValueError(f"environment variable {name} is not set")
    return value


class EdgeProvider(ABC):
    @abstractmethod
    def edges(self, concept: str) -> list[tuple[str, str, str, float]]:
        """(start label, end label, relation label, weight) of a concept, in order."""


class HttpEdges(EdgeProvider):
    """JSON documents with a list ``edges`` of start, end, rel (each with a label) and weight (1 if missing)."""

    def __init__(self, url: str = "http://api.conceptnet.io/c/en/{concept}", timeout: float = 20.0):
        self.url, self.timeout = url, timeout

    def edges(self, concept: str) -> list[tuple[str, str, str, float]]:
        with urllib.request.urlopen(self.url.format(concept=urllib.parse.quote(concept)), timeout=self.timeout) as answer:
            return self.read(json.load(answer))

    @staticmethod
    def read(document: dict) -> list[tuple[str, str, str, float]]:
        return [(e["start"]["label"], e["end"]["label"], e["rel"]["label"], float(e.get("weight", 1.0))) for e in document.get("edges", [])]


def fetch_edges(concepts: DataFrame, provider: EdgeProvider) -> DataFrame:
    """concept, start_label, end_label, rel_label, weight, seq, error of concepts (concept_code); a failed call is one row with its error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for concept in batch.column(0).to_pylist():
                try:
                    rows += [(concept, *e, i, None) for i, e in enumerate(provider.edges(concept))]
                except Exception as e:  # one concept's failure is kept with its row
                    rows.append((concept, None, None, None, None, -1, str(e)))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string())
                names = ["concept", "start_label", "end_label", "rel_label", "weight", "seq", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    one = concepts.select("concept_code").where(F.col("concept_code").isNotNull()).distinct()
    return one.mapInArrow(work, "concept string, start_label string, end_label string, rel_label string, weight double, seq long, error string")


class SparqlEndpoint:
    """An endpoint that answers queries with JSON bindings."""

    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout = url, timeout

    def ask(self, query: str) -> dict:
        body = urllib.parse.urlencode({"query": query}).encode()
        request = urllib.request.Request(self.url, body, {"Accept": "application/sparql-results+json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def values(self, query: str, variable: str) -> list[str]:
        return [b[variable]["value"] for b in self.ask(query)["results"]["bindings"] if variable in b]


def fetch_terms(concepts: DataFrame, endpoint: SparqlEndpoint, queries: dict[str, tuple[str, str]], k: int = 3) -> DataFrame:
    """concept_code, a list for each of ``queries`` (name: query with {code}, variable), error.

    Values are lower-cased, the first k different ones kept. A code that is no plain name is never put into a query.
    """
    names = list(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code in batch.column(0).to_pylist():
                lists, error = [[] for _ in names], None
                try:
                    if not code.replace("_", "").replace("-", "").isalnum():
                        raise ValueError("not a plain code")
                    lists = [list(dict.fromkeys(v.lower() for v in endpoint.values(q.replace("{code}", code), x)))[:k] for q, x in queries.values()]
                except Exception as e:  # one concept's failure is kept with its row
                    error = str(e)
                rows.append((code, *lists, error))
            if rows:
                kinds = (pa.string(), *[pa.list_(pa.string()) for _ in names], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["concept_code", *names, "error"])

    one = concepts.select("concept_code").where(F.col("concept_code").isNotNull()).distinct()
    lists = ", ".join(f"{n} array<string>" for n in names)
    return one.mapInArrow(work, f"concept_code string, {lists}, error string")
