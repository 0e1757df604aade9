import json
import random
import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import triples as t
from lexiloom.sources import alignments, dictionary, predictions, rdf


def test_generic_alignment(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('source,source_uri,target,target_uri,Relation\nsoil,http://a#soil,earth,http://b#earth, 1 \n"x, y",u, t ,v,\n')
    rows = alignments.load(spark, str(p)).collect()
    assert [tuple(rows[0].src), tuple(rows[0].tgt), rows[0].label] == [("soil", "http://a#soil"), ("earth", "http://b#earth"), "1"]
    assert rows[1].src.code == "x, y" and rows[1].tgt.code == " t " and rows[1].label == ""
    p.write_text("source,target,relation\na,b,0\n")
    assert alignments.load(spark, str(p)).first().label == "0"
    p.write_text("source,target\na,b\n")
    row = alignments.load(spark, str(p)).first()
    assert row.label == "1" and row.src.uri == ""


def test_candidate_alignment(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text(
        "src_code,src_ety,tgt_code,tgt_ety,tgt_cands,score\n"
        "C1,http://n#C1,D1,http://d#D1,\"['http://d#D1', 'http://d#D2']\",1\n"
        "C2,http://n#C2,D3,http://d#D3,[],1\n"
        "C3,http://n#C3,D4,http://d#D4,\"['D4x']\",0\n"
    )
    df = alignments.load(spark, str(p), "ncit-doid")
    got = sorted((r.src.code, r.tgt.code, r.label) for r in df.collect())
    assert got == [("C1", "D1", "1"), ("C1", "D2", "0"), ("C2", "D3", "1"), ("C3", "D4x", "0")]
    assert sorted(r.code for r in alignments.nodes(df, "tgt").collect()) == ["D1", "D3", "D4"]


def test_dictionary(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    rows = [{"concept_code": "a", "parents": ["p2", "p1"], "labels": ["l"]}, {"concept_code": "a", "parents": ["p1", "p3"], "children": "no list"}, {"parents": ["x"]}, {"concept_code": "b"}]
    p.write_text("\n\n".join(map(json.dumps, rows)) + "\n  \n")
    got = {r.concept_code: r for r in dictionary.load_dictionary(spark, str(p)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].parents == ["p1", "p2", "p3"] and got["a"].children == [] and got["a"].labels == ["l"] and got["b"].synonyms == []
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        dictionary.load_dictionary(spark, str(p)).collect()


def test_predictions(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    one = {"source": "a", "target": "b", "confidence": 3}
    p.write_text("\n".join([json.dumps(one), "", "{bad", json.dumps(one | {"confidence": 9}), json.dumps({"source": "a"}), json.dumps({"source": "c", "target": "d"})]))
    got = {(r.source, r.target): r.confidence for r in predictions.read_predictions(spark, str(p)).collect()}
    assert got == {("a", "b"): 3, ("c", "d"): None}
    assert predictions.prediction_path("t", "org/m") == "results/results/t/org-m_t.jsonl"
    out = str(tmp_path / "reviews")
    predictions.append_reviews(spark.createDataFrame([("a, b", "c", "u->v")], "source string, target string, expert_edge string"), out)
    assert spark.read.option("header", True).option("escape", '"').csv(out).first().source == "a, b"


OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://ex.org/o">
<owl:Class rdf:about="#A"><rdfs:label xml:lang="en">Top</rdfs:label></owl:Class>
<owl:Class rdf:about="http://ex.org/o#B"><rdfs:subClassOf rdf:resource="#A"/><owl:equivalentClass rdf:resource="#C"/></owl:Class>
<rdfs:Class rdf:ID="C"><rdfs:subClassOf><owl:Class rdf:about="#B"/></rdfs:subClassOf><rdfs:subClassOf rdf:resource="#missing"/></rdfs:Class></rdf:RDF>"""


def test_owl(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    triples = rdf.read_owl(spark, str(tmp_path / "o.owl"))
    classes, edges, same = rdf.hierarchy(triples)
    n = "http://ex.org/o#"
    assert sorted(r.id for r in classes.collect()) == [n + "A", n + "B", n + "C"]
    assert sorted(map(tuple, edges.collect())) == [(n + "A", n + "B"), (n + "B", n + "C")]
    assert {r.id: r.others for r in same.collect()} == {n + "B": [n + "C"], n + "C": [n + "B"]}
    assert triples.where(triples.p == t.LABEL).first().lang == "en"


def test_owl_ranges(spark, tmp_path, monkeypatch):
    """A document in ranges of any size gives the triples that it gives as a whole; marks within comments and the like are none."""
    r = random.Random(4)
    names = "abcdefgh"
    parts = []
    for i in range(120):
        inner = "".join(f'<rdfs:subClassOf rdf:resource="#{r.choice(names)}{r.randrange(120)}"/>' for _ in range(r.randrange(3)))
        inner += r.choice(["", "<rdfs:seeAlso><rdf:Description><rdfs:label>in é</rdfs:label></rdf:Description></rdfs:seeAlso>", "<!-- <owl:Class> --> ", "<rdfs:comment><![CDATA[</owl:Class> <b> ]]></rdfs:comment>", "<?x <y> ?>"])
        node = r.choice(['rdf:about="#{0}{1}"', "rdf:about='&base;{0}{1}'", "", 'rdf:nodeID="n{1}"', 'rdf:about="a>b{1}"']).format(r.choice(names), i)
        parts.append(f'<owl:Class {node}>{inner}<rdfs:label xml:lang="en">{r.choice(names) * r.randrange(30)}</rdfs:label></owl:Class>' if i % 9 else f"<owl:Class {node}/>\n<!-- </rdf:RDF> <owl:Class> {'x' * r.randrange(200)} -->")
    head = """<?xml version="1.0" encoding="UTF-8"?>\n<!-- <no> -->\n<!DOCTYPE rdf:RDF [ <!ENTITY base "http://ex.org/o#"> ]>\n<rdf:RDF xml:base="http://ex.org/o" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">"""
    document = head + "\n".join(parts) + "</rdf:RDF>\n"
    (tmp_path / "a.owl").write_text(document, encoding="utf-8")
    (tmp_path / "one.owl").write_text('<owl:Class xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="x"/>')
    (tmp_path / "none.owl").write_text(head + "</rdf:RDF>")
    root = ET.fromstring(document.encode())
    assert len(root) == 120
    blank = re.compile("_:b.*")
    whole = sorted(tuple(blank.sub("_", x) for x in row) for row in rdf.triples_of(document.encode(), "a.owl"))
    whole.append(("one.owl", "x", f"{rdf.RDF}type", f"{rdf.OWL}Class", ""))
    named = None
    for size in (1 << 20, len(document) // 16, 97):
        got = sorted(map(tuple, rdf.read_owl(spark, str(tmp_path), size).collect()))
        assert sorted(tuple(blank.sub("_", x) for x in row) for row in got) == sorted(whole)
        named = named or got
        assert got == named  # blank nodes have one name, whatever the ranges
    assert len({row[1] for row in named if row[1].startswith("_:b")}) > 20
    own = rdf._Document(str(tmp_path / "a.owl"))
    for read in (64, 300):  # tags and ends across reads
        monkeypatch.setattr(rdf, "READ_BYTES", read)
        assert [e for _, e in own.elements(len(own.head), own.size, 0, 0)] == [e for _, e in rdf._Document(str(tmp_path / "a.owl")).elements(len(own.head), own.size, 0, 0)]
        assert len(list(own.elements(len(own.head), own.size, 0, 0))) == 120


class Measured(bytes):
    """Bytes that count how often their length is asked for."""

    asked = 0

    def __len__(self):
        type(self).asked += 1
        return super().__len__()


def test_owl_costs(tmp_path, monkeypatch):
    """an element's size is taken once, whatever a piece holds, and a range is walked about once for all that it may begin in."""
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://ex.org/o#">'
    one = "<o:A rdf:about='a>b{0}'><o:p>x</o:p><!-- <o:A> --><o:q><![CDATA[</o:A> <b>]]></o:q><?x <y> ?><o:r rdf:resource='/{0}'/></o:A>\n"
    n = 5000
    (tmp_path / "a.owl").write_text(head + "".join(map(one.format, range(n))) + "</rdf:RDF>")
    own = rdf._Document(str(tmp_path / "a.owl"))
    found = [(place, Measured(e)) for place, e in own.elements(len(own.head), own.size, 0, 0)]
    monkeypatch.setattr(own, "elements", lambda *a: iter(found))
    monkeypatch.setattr(rdf, "PARSE_BYTES", 200_000)
    pieces = list(own.pieces(len(own.head), own.size, 0, 0))
    assert [p for places, _ in pieces for p in places] == [p for p, _ in found] and len(found) == n
    assert Measured.asked <= 2 * n and 3 <= len(pieces) and max(len(d) for _, d in pieces) <= 200_000 + 200
    assert sorted(row for places, d in pieces for row in rdf.triples_of(d, "a.owl", places)) == sorted(rdf.triples_of((tmp_path / "a.owl").read_bytes(), "a.owl"))

    walk, met = rdf._Document.markup, []
    monkeypatch.setattr(rdf._Document, "markup", lambda *a: (met.append(tag) or tag for tag in walk(*a)))
    text = (tmp_path / "a.owl").read_bytes()
    end = own.aligned(own.size - 3000)
    for begin in (text.index(b"<o:A> --"), text.index(b"</o:A> <b>"), text.index(b"<y>"), text.index(b"<o:p>", 2000)):
        del met[:]
        ends, deltas = own.transitions(begin, end)
        n_met = len(met)
        for state in range(4):
            assert deltas[state] == sum(change for _, _, change in walk(own, begin, end, state)) and ends[state] == own.state
        assert n_met < 1.1 * len(list(walk(own, begin, end, 0)))


def test_owl_steps(tmp_path):
    """an element whose children have none is one step of a walk; marks in values, comments and unparsed text do not end it."""
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://ex.org/o#">'
    plain = """<o:A rdf:about='a/>b'>x /> <o:p o:q="</" >y</o:p ><o:Ab/><!-- </o:A> - --><o:A o:r='/'></o:A>\n</o:A>"""
    deep, unparsed = "<o:A><o:p><o:A><o:p/></o:A></o:p></o:A>", "<o:A><o:p/><![CDATA[</o:A>]]></o:A>"
    (tmp_path / "a.owl").write_text(head + plain + deep + unparsed + plain + "<o:A/></rdf:RDF>")
    own = rdf._Document(str(tmp_path / "a.owl"))
    assert [e.decode() for _, e in own.elements(len(own.head), own.size, 0, 0)] == [plain, deep, unparsed, plain, "<o:A/>"]
    steps = [change for _, _, change in own.markup(len(own.head), None, 0)]
    assert steps == [0] + [1, 1, 0, -1, -1] + [1, 0, -1] + [0, 0] + [-1, 0]


def test_triple_sources(spark):
    o = t.OBO_IN_OWL
    rows = []
    add = lambda s, p, x, lang="": rows.append(("g", s, p, x, lang))
    for i, (label, parent) in enumerate([("Root", None), ("Mid", 0), ("Leaf", 1), ("Gone", 1)]):
        s = f"{t.OBO}DOID_{i}"
        add(s, t.TYPE, f"{t.OWL}Class")
        add(s, t.LABEL, label)
        add(s, f"{o}id", f"DOID:{i}")
        add(s, f"{o}hasOBONamespace", "disease_ontology")
        add(s, f"{o}hasDbXref", f"ICD10:{i}")
        add(s, f"{o}hasDbXref", f"MESH:{i}")
        add(s, f"{o}hasExactSynonym", f"Syn{i}")
        if parent is not None:
            add(s, t.SUB, f"{t.OBO}DOID_{parent}")
    add(f"{t.OBO}DOID_3", f"{t.OWL}deprecated", "true")
    for p, x in ((t.TYPE, f"{t.OWL}Axiom"), (f"{t.OWL}annotatedSource", f"{t.OBO}DOID_1"), (f"{t.OWL}annotatedProperty", f"{o}hasExactSynonym"), (f"{t.OWL}annotatedTarget", "Syn1"), (f"{o}hasSynonymType", f"{t.OBO}OMO_0003012")):
        add("_:ax", p, x)
    add(f"{t.DBO}City", t.TYPE, f"{t.DBO}Place")
    add("http://x/Paris", t.TYPE, f"{t.DBO}City")
    add("http://x/Paris", f"{t.SKOS}altLabel", "Paname", "en")
    add("http://x/Paris", f"{t.SKOS}altLabel", "Lutetia", "la")
    add(f"{t.DBO}City", f"{t.SKOS}altLabel", "Town", "en")
    df = spark.createDataFrame(rows, "graph string, s string, p string, o string, lang string")
    codes = spark.createDataFrame([("1",), ("3",), ("9",)], "concept_code string")
    got = {r.concept_code: r for r in t.doid_terms(df, codes).collect()}
    assert got["1"].parents == ["root", "mid"] and got["1"].children == ["mid", "leaf"] and got["1"].synonyms == ["syn1"] and got["1"].labels == ["mid"]
    assert got["3"].synonyms == [] and got["9"].labels == []
    syn = t.doid_synonyms(df, codes).collect()
    assert [(r.concept_code, r.syn_is_acronym) for r in syn] == [("1", True)]
    city = t.dbpedia_terms(df, spark.createDataFrame([("City",)], "concept_code string")).first()
    assert city.parents == [f"{t.DBO}place".lower()] and city.children == ["http://x/paris"] and city.synonyms == ["paname"] and city.labels == ["town"]


def test_ncit_annotations(spark):
    s, prop, ann = f"{t.NCIT}C1", f"{t.NCIT}P90", f"{t.NCIT}P383"
    rows = [(s, prop, "Syn A"), (prop, t.TYPE, f"{t.OWL}AnnotationProperty"), (prop, t.LABEL, "FULL_SYN"), (ann, t.LABEL, "group"), (s, t.LABEL, "Label One"),
            ("_:x", t.TYPE, f"{t.OWL}Axiom"), ("_:x", f"{t.OWL}annotatedSource", s), ("_:x", f"{t.OWL}annotatedProperty", prop), ("_:x", f"{t.OWL}annotatedTarget", "Syn A"), ("_:x", ann, "PT")]
    df = spark.createDataFrame([("g", *r, "") for r in rows], "graph string, s string, p string, o string, lang string")
    codes = spark.createDataFrame([("C1",)], "concept_code string")
    got = t.ncit_annotations(df, codes).collect()
    assert [tuple(r) for r in got] == [("C1", "FULL_SYN", "Syn A", "group=PT")]
    one = t.ncit_terms(df, codes).first()
    assert one.synonyms == ["syn a"] and one.labels == ["label one"] and one.parents == []


def test_list_literals(spark):
    """Lists of strings as Python reads them; tuples by their first string; anything else is told apart and makes no pair."""
    import ast
    import random

    rng = random.Random(4)
    bits = ["http://x#a", "it's", 'say "x"', "a, b", "[c]", "back\\slash", "ü", "\U0001f600", "\n", "\t", "\x07", "\x00", "", "\\n", "(d)", "end\\"]
    made = [["".join(rng.choices(bits, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 4))] for _ in range(120)]
    cells = [rng.choice([repr, ascii, lambda x: repr(tuple(x))])(x) for x in made]
    cells += ["['a',]", "( 'a' , )", '["\\101\\x42\\u0043"]', "[('u#1', 0.5), ('u#2', 1)]", "[ ]"]
    bad = ["[a]", "['a'", "['a' 'b']x", "'a'", "('a')", "['a', [1]]", "nan", "['a'; 'b']"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells + bad)], "i int, c string")
    got = {r.i: r.x for r in df.select("i", alignments.read_list(F.col("c")).alias("x")).collect()}
    for i, c in enumerate(cells):
        assert got[i] == [x[0] if isinstance(x, tuple) else x for x in ast.literal_eval(c)], c
    assert all(got[len(cells) + k] is None for k in range(len(bad)))
    rows = spark.createDataFrame([("s", "u#s", "t", "u#t", c, "1") for c in bad + ["[]", "['u#t']"]], "src_code string, src_ety string, tgt_code string, tgt_ety string, tgt_cands string, score string")
    assert alignments.candidate_pairs(rows).count() == 2 and alignments.unread_candidates(rows).count() == len(bad)
