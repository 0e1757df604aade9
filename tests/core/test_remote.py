import http.server
import io
import json
import re
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexiloom import __main__ as cli
from lexiloom.operators import agents, embed, knowledge, sampling, triples
from lexiloom.schemas import TERMS
from lexiloom.sources import predictions, remote, sparql
from lexiloom.streaming import incremental


def test_providers(spark):
    # local classes travel by value: workers do not see test modules
    class Edges(remote.EdgeProvider):
        def edges(self, concept):
            if concept == "bad":
                raise OSError("no answer")
            return remote.HttpEdges.read({"edges": [{"start": {"label": concept}, "end": {"label": "x"}, "rel": {"label": "IsA"}}, {"start": {"label": "y"}, "end": {"label": concept}, "rel": {"label": "Synonym"}, "weight": 2}]})

    class Endpoint(remote.SparqlEndpoint):
        def ask(self, query):
            return {"results": {"bindings": [{"label": {"value": v}} for v in (query, "B", "b", "C", "D")] + [{"other": {"value": "z"}}]}}

    rows = spark.createDataFrame([("cat",), ("cat",), ("bad",), (None,)], "concept_code string")
    got = sorted(map(tuple, remote.fetch_edges(rows, Edges()).collect()), key=str)
    assert got == sorted([("cat", "cat", "x", "IsA", 1.0, 0, None), ("cat", "y", "cat", "Synonym", 2.0, 1, None), ("bad", None, None, None, None, -1, "no answer")], key=str)
    codes = spark.createDataFrame([("C1",), ("x} drop",)], "concept_code string")
    out = {r.concept_code: r for r in remote.fetch_terms(codes, Endpoint("http://none"), {"labels": ("Q {code}", "label")}).collect()}
    assert out["C1"].labels == ["q c1", "b", "c"] and out["x} drop"].labels == [] and out["x} drop"].error


class Answers(http.server.BaseHTTPRequestHandler):
    """Answers queries of ``sparql`` from known rows: (list, start) to tuples of its variables. Every third request is refused first."""

    known, asked, refuse = {}, [], False

    def do_POST(self):
        query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        type(self).asked.append(query)
        if self.refuse and len(self.asked) % 3 == 1:
            self.send_error(503)
            return
        starts = re.findall("<(.*?)>", re.search(r"VALUES \?start \{(.*?)\}", query)[1])
        names = re.search(r"SELECT DISTINCT (.*)", query)[1].replace("?", "").split()
        name = next(k for k, r in sparql.SOURCES["doid"].relations.items() if r.body in query)
        page, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups())
        rows = sorted((s, *r) for s in starts for r in set(self.known.get((name, s), [])))[offset : offset + page]
        body = json.dumps({"results": {"bindings": [dict(zip(names, ({"value": x} for x in r), strict=True)) for r in rows]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Answers.known, Answers.asked, Answers.refuse = {}, [], False
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def doid(n):
    """A heap of diseases as triples, and what an endpoint would answer about each."""
    up = {i: (i - 1) // 3 for i in range(1, n)}
    name = lambda i: f"{triples.OBO}DOID_{i}"
    rows, known = [], {}
    for i in range(n):
        s = name(i)
        rows += [(s, triples.TYPE, f"{triples.OWL}Class"), (s, triples.LABEL, f"Label {i // 2}"), (s, f"{triples.OBO_IN_OWL}id", f"DOID:{i}"), (s, f"{triples.OBO_IN_OWL}hasOBONamespace", "disease_ontology")]
        rows += [(s, f"{triples.OBO_IN_OWL}hasDbXref", f"ICD10:{i}"), *((s, f"{triples.OBO_IN_OWL}hasExactSynonym", f"Syn {i} {j}") for j in range(i % 5))]
        rows += [(s, triples.SUB, name(up[i]))] if i else []
        known["labels", s] = [(f"Label {i // 2}",)]
        known["synonyms", s] = [(f"DOID:{i}", f"Syn {i} {j}") for j in range(i % 5)]
        at = i
        while True:
            known.setdefault(("parents", s), []).append((f"DOID:{at}", f"Label {at // 2}", f"ICD10:{at}", name(at)))
            known.setdefault(("children", name(at)), []).append((f"DOID:{i}", f"Label {i // 2}", f"ICD10:{i}", s))
            if at == 0:
                break
            at = up[at]
    return [("g", *r, "") for r in rows], known


def test_sparql(spark, endpoint):
    """Blocks of concepts, pages, tries: the lists equal those of the patterns on the triples themselves."""
    rows, Answers.known = doid(60)
    t = spark.createDataFrame(rows, "graph string, s string, p string, o string, lang string")
    codes = spark.createDataFrame([(str(i),) for i in range(45)] + [("3",), ("99",), ("x> drop",), (None,)], "concept_code string")
    want = {r.concept_code: r for r in triples.doid_terms(t, codes.where("concept_code not like 'x%'")).collect() if r.concept_code is not None}
    source, at = sparql.endpoint_of(f"doid={endpoint}")
    for page, block, refuse in ((10_000, 20, False), (7, 20, False), (50, 5, True)):
        Answers.asked, Answers.refuse = [], refuse
        got = {r.concept_code: r for r in sparql.fetch(codes, source, at, block=block, page=page, tasks=1, wait=0.0).collect()}
        assert got.pop("x> drop").error == "not a plain code" and not any(r.error for r in got.values())
        assert {c: [r[k] for k in TERMS] for c, r in got.items()} == {c: [r[k] for k in TERMS] for c, r in want.items()}
        assert "drop" not in "".join(Answers.asked)
        if page == 10_000:
            assert len(Answers.asked) == 4 * 3  # 46 codes in blocks of 20, four lists
    Answers.refuse = False
    spent = sparql.fetch(codes, source, at, block=20, tasks=1, budget=5, wait=0.0).collect()
    assert sum(r.error is None for r in spent) == 20 and any("spent" in (r.error or "") for r in spent)
    with pytest.raises(ValueError):
        sparql.endpoint_of("other")
    assert sparql.endpoint_of("ncit")[1].url == sparql.ENDPOINTS["ncit"]
    for source in sparql.SOURCES.values():  # every query is whole
        for name, r in source.relations.items():
            query = source.text(name, ["C1", "C2"], 10, 20)
            assert set(re.findall(r"\?(\w+)", query)) >= {"start", "value", *r.order} and query.count("{") == query.count("}")
            assert set(re.findall(r"\b([a-z]+):[A-Za-z]", re.sub(r"<.*?>|\".*?\"", "", r.body))) <= set(source.prefixes)


def test_command_line_sparql(spark, endpoint, tmp_path):
    rows, Answers.known = doid(10)
    (tmp_path / "m.json").write_text(json.dumps({"agent_type": "rules", "agent_name": "rules", "task": "toy", "query_options": ["doid"]}))
    (tmp_path / "a.csv").write_text("source,source_uri,target,target_uri,Relation\n2,u,3,v,1\n4,u,9,v,0\n")
    cli.main(["--method_config", str(tmp_path / "m.json"), "--csv", str(tmp_path / "a.csv"), "--sparql", f"doid={endpoint}", "--out", str(tmp_path)], spark)
    out = {r.source: r for r in predictions.read_predictions(spark, f"{tmp_path}/results/results/toy/rules_toy.jsonl").collect()}
    assert out["2"].source_label == "label 1" and out["2"].target_label == "label 1" and len(Answers.asked) >= 4


def test_chat_and_env(monkeypatch):
    chat = agents.create_chat("openai", "gpt-4o-mini")
    assert chat.body("s", "u")["messages"][1]["content"] == "u"
    assert chat.read({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}) == ("hi", 3, 1)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError):
        chat.complete("s", "u")
    monkeypatch.setenv("SOME_KEY", "v")
    assert remote.get_env("SOME_KEY") == "v"
    e = embed.create_embedder("huggingface", model="m")
    with pytest.raises(ImportError):
        e.encode(["x"])


def test_few_targets(spark):
    s = spark.createDataFrame([(f"s{i}",) for i in range(300)], "s string")
    t = spark.createDataFrame([(f"t{i}",) for i in range(3)], "t string")
    seen = spark.createDataFrame([("s1", "t1")], "s string, t string")
    assert sampling.negatives(s, t, seen, [F.col("s"), F.col("t")], 500).count() == 500
    assert sampling.negatives(s, t, seen, [F.col("s"), F.col("t")], 5000).count() == 899


def test_command_line(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"agent_type": "rules", "agent_name": "org/rules", "task": "toy", "method_name": "m", "query_options": ["mi"]}))
    (tmp_path / "d.json").write_text(json.dumps({"task_name": "toy", "sample_sz": 4}))
    (tmp_path / "a.csv").write_text("source,source_uri,target,target_uri,Relation\n" + "".join(f"name {w},u{i},{'name ' + w if i % 2 else 'other'},v{i},{i % 2}\n" for i, w in enumerate("abcdefghij")))
    (tmp_path / "k.jsonl").write_text(json.dumps({"concept_code": "name b", "labels": ["name b"]}) + "\n")
    argv = ["--method_config", str(tmp_path / "m.json"), "--dataset_config", str(tmp_path / "d.json"), "--csv", str(tmp_path / "a.csv"), "--dictionary", f"mi={tmp_path / 'k.jsonl'}", "--out", str(tmp_path), "--active_learning"]
    path = cli.main(argv, spark)
    assert path.endswith("results/results/toy/org-rules_toy.jsonl") and predictions.read_predictions(spark, path).count() == 8
    cli.main(argv, spark)  # all pairs are done: nothing is added
    assert predictions.read_predictions(spark, path).count() == 8
    cli.review_rows(spark.createDataFrame([("a", "b")], "u string, v string"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().expert_edge == "a->b"


def test_command_line_graph(spark, tmp_path):
    """An ontology as a source and for structure, and the graph of accepted answers with its reviews."""
    (tmp_path / "m.json").write_text(json.dumps({"agent_type": "rules", "agent_name": "rules", "task": "toy", "query_options": ["ontology"]}))
    (tmp_path / "d.json").write_text(json.dumps({"sample_sz": 1}))
    (tmp_path / "a.csv").write_text("source,source_uri,target,target_uri,Relation\nname a,u,name a,v,1\nname b,u,other,v,0\n")
    ns = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"'
    (tmp_path / "o.owl").write_text(f'<rdf:RDF {ns}><owl:Class rdf:about="x"/><owl:Class rdf:about="name a"><rdfs:subClassOf rdf:resource="x"/></owl:Class></rdf:RDF>')
    argv = ["--method_config", str(tmp_path / "m.json"), "--dataset_config", str(tmp_path / "d.json"), "--csv", str(tmp_path / "a.csv"), "--ontology", str(tmp_path / "o.owl"), "--out", str(tmp_path), "--graph", "5"]
    path = cli.main(argv, spark)
    assert predictions.read_predictions(spark, path).count() == 2
    kept = incremental.GraphStore(spark, f"{path.removesuffix('.jsonl')}.graph").load()
    assert {tuple(e) for e in kept.edges.collect()} == {("name a", "name a")} and kept.classes.count() == 3


def test_failing_source(spark):
    """A source that fails when it runs is skipped, and said so."""
    def fails(concepts):
        return concepts.select("concept_code", *[F.expr(f"if(length(concept_code) > 0, raise_error('away'), cast(array() as array<string>)) as {k}") for k in knowledge.TERMS])

    concepts = spark.createDataFrame([("a",)], "concept_code string")
    with pytest.warns(UserWarning, match="ncit"):
        got = knowledge.query(concepts, ["ncit"], knowledge.Sources(triples={"ncit": fails})).first()
    assert got.source_error == "ncit" and got.parents == []


def test_calls_again(monkeypatch):
    calls = []

    def answer(request, timeout):
        calls.append(json.loads(request.data))
        if len(calls) < 3:
            raise urllib.error.URLError("busy")
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setattr(urllib.request, "urlopen", answer)
    one = agents.OpenAIProvider("m", response_format={"type": "json_object"}, wait=0)
    assert one.complete("s", "u") == ("yes", 0, 0) and len(calls) == 3 and calls[0]["response_format"] == {"type": "json_object"}
    calls.clear()
    with pytest.raises(urllib.error.URLError):
        agents.OpenAIProvider("m", tries=2, wait=0).complete("s", "u")
