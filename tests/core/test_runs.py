import json
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1])]

import oracle

from lexiloom import queries
from lexiloom.operators import agents, refine
from lexiloom.plans import evaluation
from lexiloom.operators import embed, knowledge
from lexiloom.sources import alignments, predictions
from lexiloom.streaming import incremental

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.SQL:
        assert not oracle.differ(df, queries.SQL[name], DIR)
    else:
        assert df.count() > 0


def toy(spark):
    rows = [(f"thing {i}", f"http://a#{i}", f"thing {i}" if i % 2 else f"other {i}", f"http://b#{i}", str(i % 2)) for i in range(30)]
    raw = spark.createDataFrame(rows, "source string, source_uri string, target string, target_uri string, Relation string")
    return alignments.pairs(raw)


def test_run_and_resume(spark, tmp_path):
    words = spark.createDataFrame([(f"thing {i}", ["http://x/p"], [], [], [f"thing {i}"]) for i in range(30)], "concept_code string, parents array<string>, children array<string>, synonyms array<string>, labels array<string>")
    own = evaluation.Settings(options=["mi"], sample=10, agents=agents.create_agents(2, "rules", "rules"), rounds=2, gate=True)
    sources = knowledge.Sources({"mi": words})
    out = evaluation.records(evaluation.predict(toy(spark), sources, own)).cache()
    assert out.count() == 20 and out.where("true_relation = 1").count() == 10
    assert out.where("true_relation = 1 and pred_relation = 1").count() == 10
    path = str(tmp_path / "run.jsonl")
    predictions.append_predictions(out, path)
    done = predictions.read_predictions(spark, path)
    assert done.count() == 20
    assert evaluation.predict(toy(spark), sources, own, done=done).count() == 0
    row = evaluation.summary(out, "m", "t", ["mi"])
    assert row.first().metrics.recall == 1.0 and row.first().api_metrics.api_calls == 80
    predictions.write_metrics(row, path)
    assert spark.read.json(str(tmp_path / "run.metrics.json")).count() == 1 and predictions.metrics_json(row)["method"] == "m"


def test_made_negatives_and_structure(spark):
    only = toy(spark).where("label = '1'")
    edges = spark.createDataFrame([(f"thing {i}", f"thing {i + 2}") for i in range(1, 20, 2)], "parent string, child string")
    own = evaluation.Settings(sample=5, structure={"dim": 4, "length": 3, "per_node": 2}, embedder=embed.HashEmbedder(16))
    out = evaluation.predict(only, knowledge.Sources(), own, edges=edges).collect()
    assert len(out) == 10 and sum(r.true_relation for r in out) == 5
    blocks, small = evaluation.compress(edges)
    assert blocks.count() == 11 and small.count() == 10


def test_settings():
    s = evaluation.Settings.from_config({"agent_configs": [{"agent_type": "rules", "agent_name": "a"}] * 2, "n_rounds": 3, "query_options": ["mi"]}, {"sample_sz": 7})
    assert len(s.agents) == 2 and s.rounds == 3 and s.sample == 7
    assert evaluation.Settings.from_config({"agent_type": "rules", "agent_name": "a"}).rounds == 1


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", incremental.GraphStore(spark, str(tmp_path / "state"))
    source.mkdir()
    rows = [{"seq": i, "u": u, "v": v, "pred": 1} for i, (u, v) in enumerate([("a", "b"), ("b", "c"), ("a", "c")])]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows[:2])))
    for _ in range(2):  # the second run finds nothing new
        incremental.run_stream(spark, str(source), store, str(tmp_path / "check"), refresh_every=3)
    assert store.last()[2] == 2
    (source / "2.json").write_text(json.dumps(rows[2]))
    incremental.run_stream(spark, str(source), store, str(tmp_path / "check"), refresh_every=3)
    state = store.load()
    assert store.last()[2] == 3
    assert {tuple(e) for e in state.edges.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {r.id: r.rank for r in state.ranks.collect()} == {"a": 0, "b": 1, "c": 2}
    version = store.last()
    incremental.apply_batch(store, spark.createDataFrame([(9, "x", "y", 1)], "seq long, u string, v string, pred int"), version[1])
    assert store.last() == version  # a replayed batch changes nothing
    assert isinstance(state, refine.State)


def test_store_of_deltas(spark, tmp_path):
    """A batch that failed leaves nothing to see, compaction changes no answer, and a batch's bytes do not grow with the graph."""
    size = lambda n: sum(f.stat().st_size for f in tmp_path.glob(f"{n}/*/delta-1/*.parquet"))
    written = []
    for n in (10, 4000):
        store = incremental.GraphStore(spark, str(tmp_path / str(n)))
        edges = spark.range(n).selectExpr("concat('p', id % 7) as parent", "concat('c', id) as child")
        known = edges.selectExpr("child as id", "1 as rank", "true as settled").unionByName(edges.selectExpr("parent as id", "0 as rank", "true as settled").distinct())
        store.begin(edges, known)
        rows = spark.createDataFrame([(i, f"p{i}", f"c{i}", 1) for i in range(5)] + [(5, "new", "c1", 0)], "seq long, u string, v string, pred int")
        before = store.table("labels").count()
        store._commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            incremental.apply_batch(store, rows, 0, refresh_every=0)
        del store._commit
        assert store.last() == (0, -1, 0) and store.table("labels").count() == before
        incremental.apply_batch(store, rows, 0, refresh_every=0)
        written.append(size(n))
        want = {f"p{i}": f"c{i}" for i in range(5)} | {f"c{i}": f"c{i}" for i in range(5)} | {"new": "new"}
        assert {r.id: r.block for r in store.load().classes.collect()} == want
        assert store.table("edges").count() == n and store.last() == (1, 0, 6)
        store.compact()
        assert {r.id: r.block for r in store.load().classes.collect()} == want and store.table("links").count() == 0
    assert written[1] < 1.2 * written[0]


def test_first_version_is_a_base(spark, tmp_path):
    """Edges are written once, and levels found from there; neither is merged when read."""
    store = incremental.GraphStore(spark, str(tmp_path / "state"))
    asked = []
    store.begin(spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string"), lambda edges: (asked.extend(edges.inputFiles()), incremental.levels.levels(None, edges))[1])
    assert asked and all(str(tmp_path) in f for f in asked)
    assert store.mark().base == 0 and store.table("edges").count() == 2
    assert {r.id: r.rank for r in store.load().ranks.collect()} == {"a": 0, "b": 1, "c": 2} and not store.load().classes.count()
    assert "Exchange" not in store.table("levels")._jdf.queryExecution().executedPlan().toString()


def test_sink_commits_once(spark, tmp_path):
    path = str(tmp_path / "s.jsonl")
    row = "'a' as source_label, '' as target_label, concat('s', id) as source, '' as source_uri, 't' as target, '' as target_uri, 0.5D as similarity, 7 as confidence, 1 as true_relation, 1 as pred_relation, named_struct('input_token', 1L, 'output_token', 2L, 'api_calls', 1L) as api_metrics, true as accepted"
    rows = spark.range(6).selectExpr(f"inline(array(struct({row})))")
    assert predictions.next_batch(spark, path) == 0
    rows.where("source < 's3'").select("*").write.json(f"{path}/batch=0")  # written, then lost before the commit
    assert predictions.commits(spark, path) == []
    predictions.append_predictions(rows.where("source < 's4'"), path, 0)
    predictions.append_predictions(rows.where("source < 's2'"), path, 0)  # tried again after the commit
    predictions.append_predictions(rows.where("source >= 's4'"), path)
    assert predictions.commits(spark, path) == [0, 1]
    assert sorted(r.source for r in predictions.read_predictions(spark, path).collect()) == [f"s{i}" for i in range(6)]


def test_edges_of_odd_rows(spark, tmp_path):
    """Repeated rows and null keys: the edges are the distinct ones by name, and names are not what is made distinct."""
    null = [(None, 1, 1, 1), (None, 1, 2, None), (1, None, None, 1), (1, None, None, None), (1, 11, None, None), (11, 1, 3, 3)]
    tables = {
        "nation": ("n_nationkey int, n_regionkey int", [(1, 0), (1, 0), (2, None)]), "customer": ("c_custkey long, c_nationkey int", [(1, 1), (1, 1), (None, None)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 1), (2, 1), (None, None)]), "orders": ("o_orderkey long, o_custkey long", [(1, 1), (1, 1), (1, 2), (None, 1), (None, None)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 2), (1, 2, 1, 2), *null, *null]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).createOrReplaceTempView(name)
    want = spark.sql(f"WITH {queries.EDGES_SQL} SELECT parent, child FROM hedges").collect()
    edges = queries._edges(spark, str(tmp_path))
    got = edges.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == len(set(want))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [l_orderkey" in x and "l_linenumber" in x for x in plan.splitlines())
