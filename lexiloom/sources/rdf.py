"""RDF/XML ontologies as triples, and the class hierarchy in them."""

from __future__ import annotations

import functools
import os
import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRIPLE

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XML = "http://www.w3.org/XML/1998/namespace"
#: Attributes as the parser names them.
ABOUT, ID, NODE, RESOURCE, LANG = f"{{{RDF}}}about", f"{{{RDF}}}ID", f"{{{RDF}}}nodeID", f"{{{RDF}}}resource", f"{{{XML}}}lang"
#: Namespaces whose attributes are no properties.
OWN = (f"{{{RDF}}}", f"{{{XML}}}")
TYPE, DESCRIPTION = f"{RDF}type", f"{RDF}Description"


@functools.lru_cache(1 << 16)
def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def triples_of(document: str | bytes, graph: str = "", places: list[int] | None = None) -> Iterator[tuple]:
    """Triples (graph, s, p, o, lang) of one RDF/XML document.

    Blank nodes without a name are numbered within their top-level element and led by its place: ``places``, or its number.
    """
    root = ET.fromstring(document)
    base = root.get(f"{{{XML}}}base", "")
    top = list(root) if _iri(root.tag) == f"{RDF}RDF" else [root]

    def absolute(ref: str) -> str:
        return base.rstrip("#") + ref if ref.startswith("#") else ref

    for place, first in zip(places or range(len(top)), top, strict=True):
        numbers = iter(range(1 << 62))

        def subject(node: ET.Element, place: int = place, numbers: Iterator[int] = numbers) -> str:
            ref = node.get(ABOUT)
            if ref is not None:
                return absolute(ref)
            ref = node.get(ID)
            if ref is not None:
                return absolute(f"#{ref}")
            return f"_:{node.get(NODE) or f'b{place}-{next(numbers)}'}"

        rest = [(first, subject(first), root.get(LANG, ""))]
        while rest:
            node, s, lang = rest.pop()
            lang, kind = node.get(LANG, lang), _iri(node.tag)
            if kind != DESCRIPTION:
                yield graph, s, TYPE, kind, ""
            for key, value in node.items():
                if not key.startswith(OWN):
                    yield graph, s, _iri(key), value, lang
            for prop in node:
                p, ref = _iri(prop.tag), prop.get(RESOURCE)
                if ref is not None or prop.get(NODE) is not None:
                    yield graph, s, p, absolute(ref) if ref is not None else f"_:{prop.get(NODE)}", ""
                elif len(prop):
                    for child in prop:
                        o = subject(child)
                        yield graph, s, p, o, ""
                        rest.append((child, o, lang))
                else:
                    yield graph, s, p, prop.text or "", prop.get(LANG, lang)


#: Bytes of a range of a document, of a read, and of the elements that are parsed at once.
RANGE_BYTES, READ_BYTES, PARSE_BYTES = 16 << 20, 1 << 20, 1 << 20
#: What a place of a document may lie in, and what ends it: content or a tag, a comment, unparsed text, an instruction.
ENDS = (b"", b"-->", b"]]>", b"?>")
_BEGUN, _COMMENT = rb"(<!--)|(<!\[CDATA\[)|(<\?)|", rb"<!--[^-]*+(?:-(?!->)[^-]*+)*+-->"
_TAG = rb"<([^<>!?/\"'\s][^<>\"'\s/]*+)[^<>\"']*+(?:\"[^\"]*+\"[^<>\"']*+|'[^']*+'[^<>\"']*+)*+>"
_CHILD = _TAG + rb"(?:(?<=/>)|[^<]*+</\6\s*+>)"
#: The beginning of a place of kind 1 to 3, or a tag (4).
FIRST = re.compile(_BEGUN + _TAG)
#: A whole comment, the beginning of a place of kind 1 to 3, an end tag (4), a tag (5, 6), an element whose children have none (7).
MARKUP = re.compile(_COMMENT + rb"|" + _BEGUN + rb"<(/)[^<>\"']++>|" + _TAG + rb"(?:(?<!/>)(?:[^<]*+(?:" + _COMMENT + rb"|" + _CHILD + rb"))*+[^<]*+</\5\s*+>())?")
SLASH = ord("/")
#: Tags of a range that its other walks are compared with.
KNOWN_TAGS = 4096


class _Document:
    """A document read by places. Its head, all before the first element below the root, leads every parse."""

    def __init__(self, path: str):
        where = path if "://" in path or not path.startswith("file:") else path[5:]
        system, name = FileSystem.from_uri(urllib.parse.quote(where, safe=":/@%=")) if "://" in where else (LocalFileSystem(), where)
        self.file, self.name = system.open_input_file(name), os.path.basename(path)
        self.size = self.file.size()
        self.head, self.tail, self.plain = b"", b"", False
        while not self.tail and len(self.head) < self.size:
            self.head = self.file.read_at(len(self.head) + READ_BYTES, 0)
            prolog = re.sub(rb"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", lambda m: b" " * len(m[0]), self.head, flags=re.S)
            root = FIRST.search(prolog)
            if root and root.lastindex == 4:
                name = re.match(rb"<([^\s/>]+)", root[0])[1]
                self.plain = name.split(b":")[-1] == b"RDF" and not root[0].endswith(b"/>") and not self.head.startswith((b"\xff\xfe", b"\xfe\xff"))
                self.head, self.tail = self.head[: root.end()], b"</" + name + b">"

    def aligned(self, at: int) -> int:
        """The first ``<`` from a place on: no tag and no end of a comment or the like spans it. The head is before all."""
        at = max(at, len(self.head))
        while at < self.size:
            found = self.file.read_at(READ_BYTES, at).find(b"<")
            if found >= 0:
                return at + found
            at += READ_BYTES
        return self.size

    def markup(self, start: int, end: int | None, state: int) -> Iterator[tuple[int, int, int]]:
        """(place, end, change of depth) of each tag from ``start`` on, then (end, end, 0); ``end`` None: to the end of the document.

        An element of text and children without children may come as one, without a change of depth.
        What the walk lies in at the end is kept in ``self.state``; ``self.held`` is what is read at the time, from ``self.at`` on.
        """
        limit = self.size if end is None else end
        held, at, self.state = b"", start, state
        while True:
            if at + len(held) < limit:  # what is left is a tag that goes on, or little
                held += self.file.read_at(min(max(READ_BYTES, len(held)), limit - at - len(held)), at + len(held))
            self.held, self.at = held, at
            whole = at + len(held) >= limit
            used = 0
            while True:
                if self.state:
                    over = held.find(ENDS[self.state], used)
                    if over < 0:
                        used = len(held) if whole else max(used, len(held) - 2)
                        break
                    used, self.state = over + len(ENDS[self.state]), 0
                for tag in MARKUP.finditer(held, used):
                    lt, used = tag.span()
                    kind = tag.lastindex
                    if kind == 7:
                        yield at + lt, at + used, 0
                    elif kind in (5, 6):
                        yield at + lt, at + used, 0 if held[used - 2] == SLASH else 1
                    elif kind == 4:
                        yield at + lt, at + used, -1
                    elif kind:
                        self.state = kind
                        break
                else:  # what is no markup is left to the parser to say so
                    lt = -1 if whole else held.find(b"<", used)
                    used = len(held) if lt < 0 else lt
                    break
            if whole:
                break
            held, at = held[used:], at + used
        yield limit, limit, 0

    def transitions(self, start: int, end: int) -> tuple[list[int], list[int]]:
        """What a range ends in, and by how much it is deeper then, for each thing that it may begin in.

        A walk that comes to one of the first tags of the walk from content goes on as that does.
        """
        known: dict[int, int] = {}
        depth = 0
        for place, over, change in self.markup(start, end, 0):
            if len(known) < KNOWN_TAGS and over > place:
                known[place] = depth
            depth += change
        ends, deltas = [self.state], [depth]
        for state in range(1, len(ENDS)):
            own = 0
            for place, _, change in self.markup(start, end, state):
                if place in known:
                    ends.append(ends[0])
                    deltas.append(own + depth - known[place])
                    break
                own += change
            else:
                ends.append(self.state)
                deltas.append(own)
        return ends, deltas

    def elements(self, start: int, end: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the elements right below the root that begin in a range."""
        began = None
        for place, over, change in self.markup(start, None, state):
            if began is None and place >= end:
                return
            if depth == 0 and change >= 0 and over > place:
                began = place
            depth += change
            if began is not None and depth == 0:
                yield began, self.held[began - self.at : over - self.at] if began >= self.at else self.file.read_at(over - began, began)
                began = None
            if depth < 0:
                return

    def pieces(self, start: int, end: int, state: int, depth: int) -> Iterator[tuple[list[int], bytes]]:
        """The elements that begin in a range as small documents, each with the places of its elements."""
        places: list[int] = []
        held: list[bytes] = []
        n_bytes = 0
        for place, element in self.elements(start, end, state, depth):
            size = len(element)
            if places and n_bytes + size > PARSE_BYTES:
                yield places, self.head + b"".join(held) + self.tail
                places, held, n_bytes = [], [], 0
            places.append(place)
            held.append(element)
            n_bytes += size
        if places:
            yield places, self.head + b"".join(held) + self.tail


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """What each range of one document begins in, and how deep: a row a range, so few for any document."""
    rows = rows.sort_values("start").reset_index(drop=True)
    state, depth, states, depths = 0, 0, [], []
    for ends, deltas in zip(rows["ends"], rows["deltas"], strict=True):
        states.append(state)
        depths.append(depth)
        state, depth = int(ends[state]), depth + int(deltas[state])
    return rows[["path", "start", "stop"]].assign(state=states, depth=depths)


def read_owl(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Triples of all documents at ``path``, each read in ranges of bytes side by side.

    First every range says, for each thing that it may begin in (content, comment, unparsed text, instruction), in what
    it ends and how the depth changes; one after the other these give every range's true beginning. Then each range
    reads the elements right below the root that begin in it, led by the document's head (declarations, entities,
    namespaces, base). A task holds an element, not a document. Documents whose root is not rdf:RDF, or in UTF-16, are one range.
    """
    size = range_bytes or RANGE_BYTES
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + size).alias("stop"))
    n = max(1, min(ranges.count(), 8 * spark.sparkContext.defaultParallelism))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _Document(name)
                first, last = own.aligned(start) if start else len(own.head), own.aligned(stop)
                # nothing comes after the last range of a document
                rows.append((name, start, stop, *(own.transitions(first, last) if own.plain and last < own.size else ([0] * len(ENDS), [0] * len(ENDS)))))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "start", "stop", "ends", "deltas"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=TRIPLE.fieldNames())

        for batch in batches:
            for name, start, stop, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _Document(name)
                if not own.plain:
                    rows = list(triples_of(own.file.read_at(own.size, 0), own.name)) if start == 0 and own.size else []
                    yield from [table(rows)] if rows else []
                    continue
                first, last = own.aligned(start) if start else len(own.head), own.aligned(stop)
                for places, document in own.pieces(first, last, state, depth):
                    rows = list(triples_of(document, own.name, places))
                    yield from [table(rows)] if rows else []

    if n > 1:
        kind = "path string, start long, stop long"
        known = ranges.repartition(n).mapInArrow(transitions, f"{kind}, ends array<int>, deltas array<long>")
        ranges = known.groupBy("path").applyInPandas(_walked, f"{kind}, state int, depth long")
    else:
        ranges = ranges.withColumns({"state": F.lit(0), "depth": F.lit(0).cast("long")})
    return ranges.repartition(n).mapInArrow(parse, TRIPLE)


def hierarchy(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes (id), edges (parent, child) between classes, synonyms (id, others) by equivalence in both directions."""
    classes = triples.where((F.col("p") == f"{RDF}type") & F.col("o").isin(f"{OWL}Class", f"{RDFS}Class")).select(F.col("s").alias("id"))
    sub = triples.where(F.col("p") == f"{RDFS}subClassOf").select(F.col("o").alias("parent"), F.col("s").alias("child"))
    edges = sub.join(classes.withColumnRenamed("id", "parent"), "parent", "left_semi").join(classes.withColumnRenamed("id", "child"), "child", "left_semi")
    same = triples.where(F.col("p") == f"{OWL}equivalentClass").select(F.col("s").alias("a"), F.col("o").alias("b"))
    same = same.join(classes.withColumnRenamed("id", "a"), "a", "left_semi").join(classes.withColumnRenamed("id", "b"), "b", "left_semi")
    both = same.select("a", "b").unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return classes.distinct(), edges.select("parent", "child").distinct(), both.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("others"))
