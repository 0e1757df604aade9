import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.functions import vectors as vec
from lexiloom.operators import agents, embed, knowledge, metrics, sampling, vectors
from lexiloom.sources import dictionary


def test_text(spark):
    uris = [("http://x/a/b#Foo", "b"), ("http://x.org#Foo", "Foo"), ("DOID:123", "123"), ("a/b;c?d=1", "b"), ("", ""), ("http://x/a/", "a"), ("plain", "plain")]
    df = spark.createDataFrame(uris, "u string, want string")
    for r in df.select("*", text.uri_term(F.col("u")).alias("got"), text.uri_name(F.col("u")).alias("name")).collect():
        assert r.got == r.want, r
    names = {r.u: r.name for r in df.select("u", text.uri_name(F.col("u")).alias("name")).collect()}
    assert names["http://x/a/b#Foo"] == "Foo" and names["http://x/a/"] == "a"
    row = spark.createDataFrame([(["ab", "a", "x_y", "c1", "m²", "ok"], [])], "x array<string>, e array<string>")
    got = row.select(text.clean_terms(F.col("x")).alias("c"), text.list_text(F.col("e")).alias("n"), text.list_text(F.col("x")).alias("l")).first()
    assert got.c == ["ab", "ok"] and got.n == "none" and got.l.startswith("ab, a")


def test_small(spark):
    row = spark.sql("select named_struct('code', 'a', 'uri', 'x') as s, named_struct('code', 'a', 'uri', 'y') as t, 'org/m' as n")
    assert tuple(row.select(text.same_code(F.col("s"), F.col("t")), text.file_safe(F.col("n")), vec.external_id(F.lit(5))).first()) == (True, "org-m", "5")
    assert sorted(r.word for r in dictionary.word_lexicon(spark, ["Cat", "cat", "dog"]).collect()) == ["cat", "dog"]


def test_parse(spark):
    said = [("<ANSWER> Yes </ANSWER><confidence>8</confidence>", 1, 8), ("", 0, 0), (None, 0, 0), ("<answer>no</answer><confidence>11</confidence>", 0, 0), ("<answer>yes</answer><Confidence>8</Confidence>", 1, 0), ("<answer>no</answer><answer>yes</answer><confidence> 10 </confidence>", 0, 10)]
    df = spark.createDataFrame(said, "r string, a int, c int")
    for r in df.select("*", text.yes_no(F.col("r")).alias("ga"), text.confidence(F.col("r")).alias("gc")).collect():
        assert (r.ga, r.gc) == (r.a, r.c), r
    gate = spark.createDataFrame([(5,), (6,)], "c int").select((text.gate_score(F.col("c")) > 0).alias("ok"))
    assert [r.ok for r in gate.collect()] == [False, True]
    noisy = spark.range(50).select(text.gate_score(F.lit(5), 1.0, epsilon=0.1, seed=3).alias("s"))
    assert noisy.agg(F.stddev("s")).first()[0] > 0.01


def test_vote(spark):
    rows = [(1, 0, 0, 3), (1, 1, 1, 9), (2, 0, 1, 7), (2, 1, 1, 8), (2, 2, 0, 2)]
    got = {r.pair_id: (r.pred, r.confidence) for r in agents.vote(spark.createDataFrame(rows, "pair_id long, seq int, ans int, conf int")).collect()}
    assert got == {1: (0, 3), 2: (1, 7)}


def plain_truncate(messages, total, reply):
    kept, used = [], len(messages[0][1]) // 4
    for m in reversed(messages[1:]):
        if used + len(m[1]) // 4 <= total - reply:
            kept.insert(0, m)
            used += len(m[1]) // 4
    notice = [("system", agents.NOTICE)] if len(kept) + 1 < len(messages) else []
    return [messages[0], *notice, *kept]


def test_truncate(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {}
    for r in df.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for total in (200, 400, 8000):
        got = {r.conv_id: [tuple(m) for m in r.messages] for r in agents.truncate(df, "conv_id", "turn", total, 150).collect()}
        assert got == {k: plain_truncate(v, total, 150) for k, v in by.items()}


def test_inference(spark):
    meta = "named_struct('parents', array(), 'children', array(), 'synonyms', array(), 'labels', array({}))"
    pairs = spark.sql(f"select 1L as pair_id, 'red car' as src_code, 'red car' as tgt_code, {meta.format('red car'.join(2 * [chr(39)]))} as src_meta, {meta.format('red car'.join(2 * [chr(39)]))} as tgt_meta, '' as context union all select 2L, 'blue', 'green', {meta.format(chr(39) + 'blue' + chr(39))}, {meta.format(chr(39) + 'green' + chr(39))}, ''")
    for c in ("src_meta", "tgt_meta"):
        pairs = pairs.withColumn(c, F.col(c).cast("struct<parents:array<string>,children:array<string>,synonyms:array<string>,labels:array<string>>"))
    own = agents.create_agents(3, "rules", "rules")
    assert pickle.loads(pickle.dumps(own))
    out = {r.pair_id: r for r in agents.inference(pairs, own, 1, gate=True).collect()}
    assert out[1].pred == 1 and out[1].accepted and out[1].api_metrics.api_calls == 3 and out[2].pred == 0
    assert {r.pair_id: r.api_metrics.api_calls for r in agents.inference(pairs, own[:2], 3).collect()} == {1: 6, 2: 6}
    with pytest.raises(ValueError):
        agents.create_chat("none")
    assert agents.agents_table(spark, own).count() == 3 and "<answer>" in agents.generate_response("s", "u")
    assert len(agents.create_agents_from_config([{"agent_type": "rules", "agent_name": "x"}])) == 1


def test_failed_calls(spark):
    """A failed call is a row with its error, has no vote and stops nothing; conversations are cut on their way."""
    class Failing(agents.ChatProvider):
        def complete(self, system, user):
            if self.model in user:
                raise OSError("away")
            return "<answer>yes</answer><confidence>9</confidence>", len(system), len(user)

    rows = spark.createDataFrame([(1, "blue"), (2, "red"), (3, None)], "pair_id long, user string")
    got = {(r.pair_id, r.agent): r for r in agents.call(rows, [Failing("blue"), Failing("zebra")], "s").collect()}
    assert got[1, 0].error == "OSError: away" and got[1, 0].response is None and sum(r.error is None for r in got.values()) == 5
    meta = "cast(named_struct('parents', array(), 'children', array(), 'synonyms', array(), 'labels', array()) as struct<parents:array<string>,children:array<string>,synonyms:array<string>,labels:array<string>>)"
    pairs = spark.sql(f"select id as pair_id, if(id = 1, 'blue', 'red') as src_code, 'x' as tgt_code, {meta} as src_meta, {meta} as tgt_meta, '' as context from range(1, 3)")
    out = {r.pair_id: (r.pred, r.api_metrics.api_calls) for r in agents.inference(pairs, [Failing("blue"), Failing("zebra")], 2).collect()}
    assert out == {1: (1, 3), 2: (1, 4)}  # in the second round the prompt holds answers, not names
    assert [r.pair_id for r in agents.inference(pairs, [Failing("blue")], 2).collect()] == [2]
    talk = spark.createDataFrame([(1, 0, "system", "lead"), (1, 1, "user", "x" * 400), (1, 2, "user", "yyyy" * 5), (2, 0, "system", "lead"), (2, 1, "user", "hi")], "id long, n int, role string, text string")
    said = {r.pair_id: (r.input_token, r.output_token) for r in agents.converse(talk, [Failing("xx")], "id", "n", 60, 20).collect()}
    assert said == {1: (4, len(f"system: {agents.NOTICE}\n\nuser: " + "yyyy" * 5)), 2: (4, 2)}


def test_prompts(spark):
    history = "array(struct(0 as agent, 1 as ans, 8 as conf), struct(1 as agent, 0 as ans, 4 as conf), struct(0 as agent, 0 as ans, 2 as conf))"
    row = spark.range(1).select(F.expr(history).alias("h")).select(agents.round_prompt(F.col("h"), False).alias("a"), agents.round_prompt(F.col("h"), True).alias("b")).first()
    assert "Agent 1: 1 (8) 0 (2)\nAgent 2: 0 (4)" in row.a and "last round" in row.b


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "true_relation int, pred_relation int")
    assert tuple(metrics.score(df).first()) == (0.5, 0.5, 0.5)
    assert tuple(metrics.score(df.limit(0)).first()) == (0.0, 0.0, 0.0)
    rows = [(i, i % 2, (i // 2) % 2) for i in range(40)]
    for buckets in (1, 4, 17):
        run = {r.i: (r.precision, r.recall) for r in metrics.running_score(spark.createDataFrame(rows, "i long, true_relation int, pred_relation int"), "i", buckets=buckets).collect()}
        for i in range(40):
            tp = sum(a and b for _, a, b in rows[:i])
            assert run[i][0] == pytest.approx(tp / max(1, sum(b for _, _, b in rows[:i])))
    price = metrics.cost(spark.createDataFrame([("openai", "gpt-4o", 1000, 100), ("x", "y", 5, 5)], "backend string, model string, input_token long, output_token long"), metrics.price_table(spark), ["model"])
    assert {r.model: r.total_cost for r in price.collect()} == {"gpt-4o": pytest.approx(0.0035), "y": 0.0}


def test_inference_moves_no_answers(spark):
    """Answers stay in their pair's row: the plan has no join, and the rows of one file are asked in more than one task."""
    meta = "named_struct('parents', array('p'), 'children', array('c'), 'synonyms', array('s'), 'labels', array('l'))"
    pairs = spark.sql(f"select id as pair_id, concat('red ', id) as src_code, concat('red ', id) as tgt_code, {meta} as src_meta, {meta} as tgt_meta, '' as context from range(0, 500, 1, 1)")
    out = agents.inference(pairs, agents.create_agents(3, "rules", "rules"), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert len(out.inputFiles()) > 1
    assert out.count() == 500 and out.where("api_metrics.api_calls = 6").count() == 500
    history = [(0, 1, 4), (1, 0, 9), (2, 0, 2), (3, 1, 7), (4, 2, 10)]
    row = spark.createDataFrame([(history,)], "h array<struct<seq: int, ans: int, conf: int>>").select(agents.vote_of(F.col("h")).alias("v")).first().v
    assert (row.pred, row.confidence) == (1, 5)


def test_top_k(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[7] = 0
    x[11] = x[10]
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ext_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(12)], "query_id long, embedding array<double>")
    got = {}
    for limit in (vectors.BLOCK_NUMBERS, 40):  # one block, and several
        vectors.BLOCK_NUMBERS, before = limit, vectors.BLOCK_NUMBERS
        rows = vectors.top_k(asked, store, 4).collect()
        vectors.BLOCK_NUMBERS = before
        assert len(rows) == 44
        got = {(r.query_id, r.nth): r.ext_id for r in rows}
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for q in range(12):
            like = np.round(unit @ unit[q], 12)
            like[7] = -9
            want = [] if q == 7 else sorted(range(60), key=lambda i: (-like[i], i))[:4]
            assert [got[q, n] for n in range(1, 5) if (q, n) in got] == want
    assert vectors.top_k(asked.limit(0), store, 3).count() == 0


def _nearest(asked, rows, k, exclude_self):
    """By definition: (query_id, nth) to ext_id."""
    out = {}
    for q, v in asked:
        like = []
        for e, w in rows:
            if len(v) == len(w) and any(v) and any(w) and not (exclude_self and e == q):
                like.append((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 10), e))
        out.update({(q, n + 1): e for n, (_, e) in enumerate(sorted(like)[:k])})
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
def test_top_k_of_blocks(spark, monkeypatch, exclude_self):
    """Block pairs: communities, a vector that is a third of all rows, repeated ids, two lengths, vectors like nothing."""
    r = np.random.default_rng(1)
    middles = r.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + 0.02 * r.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, middles[0].tolist()) for i in range(200)] + [(3, (middles[2] * 2).tolist()), (3, middles[3].tolist())]
    rows += [(2000 + i, r.normal(size=5).tolist()) for i in range(30)] + [(3000, [0.0] * 8)]
    asked = rows[:90:3] + rows[602:620] + [(4000, [1.0, 2.0]), (4001, [0.0] * 8)] + [(5000 + i, (middles[0] + 0.3 * r.normal(size=8)).tolist()) for i in range(20)]
    store = spark.createDataFrame([*rows, (6000, None), (6001, [1.0, None])], "ext_id long, embedding array<double>").repartition(3)
    ask = spark.createDataFrame([*asked, (6000, None)], "query_id long, embedding array<double>").repartition(2)
    want = _nearest(asked, rows, 3, exclude_self)
    for numbers, cell_rows in ((vectors.BLOCK_NUMBERS, 4096), (160, 20), (400, 100)):
        monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
        monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
        got = {(x.query_id, x.nth): x.ext_id for x in vectors.top_k(ask, store, 3, exclude_self).collect()}
        assert got == want


def test_meeting():
    """Cells far from a query's k best never meet it, and none that holds one is left out."""
    r = np.random.default_rng(2)
    middles = r.normal(size=(40, 16))
    x = np.repeat(middles, 50, axis=0) + 0.02 * r.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = x[::50]
    cell = (x @ unit.T).argmax(axis=1)
    angle = np.arccos(np.clip((x * unit[cell]).sum(axis=1), -1, 1))
    cells = {c: (int((cell == c).sum()), float(angle[cell == c].max())) for c in set(cell.tolist())}
    met = set(vectors.meeting(unit, cells, cells, 5))
    assert len(met) < 0.2 * len(cells) ** 2  # four fifths of all pairs of cells are never multiplied
    for q in range(0, 2000, 7):
        assert all((cell[q], cell[j]) in met for j in np.argsort(-(x @ x[q]))[:5])


def test_blocks_without_clusters(spark, monkeypatch):
    """Cells that all meet are packed into blocks, so that rows are copied and the best listed once a block, not once a cell."""
    x = np.random.default_rng(4).normal(size=(400, 8))
    x[1::4] = x[::4] + 1e-9 * x[2::4]  # single precision can't tell these apart
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 800)
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    asked = [(i, v.tolist()) for i, v in enumerate(x)]
    store = spark.createDataFrame(asked, "ext_id long, embedding array<double>").repartition(3)
    out = spark.sql("select 1L as query_id, 2L as ext_id, 0.5D as similarity").schema
    found = vectors._blocks(store.withColumnRenamed("ext_id", "query_id"), store, 3, False, out)
    assert found.count() <= 3 * 400 * 10  # forty cells, about eight blocks
    got = {(r.query_id, r.nth): r.ext_id for r in vectors.top_k(store.withColumnRenamed("ext_id", "query_id"), store, 3).collect()}
    assert got == _nearest12(asked)
    unit = x[::40] / np.linalg.norm(x[::40], axis=1, keepdims=True)
    assert sorted(len(b) for b in vectors.packed(unit, dict.fromkeys(range(9), 4) | {9: 30}, 12).values()) == [1] * 9 + [3]


def _nearest12(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(x @ x.T, 12)
    return {(q, n + 1): e for q in range(len(x)) for n, e in enumerate(sorted(range(len(x)), key=lambda e: (-like[q, e], e))[:3])}


def test_add_and_cosine(spark):
    store = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "ext_id long, embedding array<double>")
    assert vectors.add(store, store).count() == 120
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert zero.select(vec.cosine(F.col("a"), F.col("b"))).first()[0] is None
    with pytest.raises(ValueError):
        vec.combine(F.col("a"), F.col("b"), "other")


def test_embed(spark):
    e = embed.create_embedder("hash", dim=16)
    v = e.encode(["heart disease", "heart diseases", "quantum", ""])
    assert v[0] @ v[1] > v[0] @ v[2] and np.allclose(np.linalg.norm(v[:3], axis=1), 1)
    with pytest.raises(ValueError):
        embed.create_embedder("none")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    for q in (1.0, 4.0):
        paths = [r.path for r in embed.walks(nodes, edges, 5, 3, 1.0, q).collect()]
        assert len(paths) == 15 and all((a, b) in {("a", "b"), ("b", "c"), ("b", "d")} for p in paths for a, b in zip(p, p[1:], strict=False))
    s = {r.id: r.structure for r in embed.structural(nodes, edges, dim=4, length=4, per_node=3).collect()}
    assert len(s) == 5 and any(s["a"]) and len(s["z"]) == 4
    assert not any(embed.structural(nodes, edges.limit(0), dim=4).first().structure)
    text_of = spark.createDataFrame([("a", "alpha"), ("z", None)], "id string, text string")
    both = embed.combined(text_of, embed.structural(nodes, edges, dim=4, length=4, per_node=3), e)
    assert {len(r.embedding) for r in both.collect()} == {20}


def test_walks_from_a_hub(spark):
    """Neighbours have the numbers 0 to degree - 1, walks from a hub spread evenly over them, and a rerun walks the same ways."""
    edges = spark.range(3000).selectExpr("'hub' as parent", "concat('leaf', id % 1000) as child").unionByName(spark.sql("select 'leaf1' as parent, 'hub' as child union all select 'leaf1', 'leaf2' union all select null, 'x'"))
    near, degrees = embed._numbered(edges)
    assert {tuple(r) for r in degrees.collect()} == {("hub", 1000), ("leaf1", 2)}
    rows = near.where("at = 'hub'").collect()
    assert sorted(r.nth for r in rows) == list(range(1000)) and {r.next: r.next_degree for r in rows if r.next_degree} == {"leaf1": 2}
    nodes = spark.createDataFrame([("hub",), ("leaf1",), ("leaf2",), ("none",)], "id string")
    paths = {r.walk_id: r.path for r in embed.walks(nodes, edges, 8, 20_000).where("walk_id like 'hub%' or walk_id like '%#1'").collect()}
    hit = [p[1] for k, p in paths.items() if k.startswith("hub")]
    count = np.unique(hit, return_counts=True)[1]
    assert len(hit) == 20_000 and len(count) == 1000 and count.max() < 50
    known = {("leaf1", "hub"), ("leaf1", "leaf2")}
    assert all((a, b) in known or a == "hub" and b.startswith("leaf") for p in paths.values() for a, b in zip(p, p[1:], strict=False))
    assert paths["leaf2#1"] == ["leaf2"] and paths["none#1"] == ["none"] and max(map(len, paths.values())) > 3
    again = {r.walk_id: r.path for r in embed.walks(nodes, edges.repartition(3), 8, 50).collect()}
    assert all(paths[k] == p for k, p in again.items() if k in paths)


def test_communities(spark):
    """Nodes of one community are more alike in structure than nodes of two."""
    r = np.random.default_rng(5)
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(15) for j in r.choice(15, 6, replace=False).tolist() if i != j] + [("a0", "b0"), ("b1", "a1")]
    edges = spark.createDataFrame(pairs, "parent string, child string")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(15)], "id string")
    v = {x.id: np.array(x.structure) for x in embed.structural(nodes, edges, dim=16, length=20, per_node=100, window=5).collect()}
    like = lambda x, y: v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y])
    within = [like(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(15) for j in range(i)]
    across = [like(f"a{i}", f"b{j}") for i in range(15) for j in range(15)]
    assert np.mean(within) > np.mean(across) + 0.1


def test_knowledge(spark):
    with pytest.warns(UserWarning):
        rows = spark.createDataFrame([("a",), ("b",)], "concept_code string")
        words = spark.createDataFrame([("a", ["http://x/p#q|DOID:1", "p2", "p3", "p4"], [], ["s", "s"], None)], "concept_code string, parents array<string>, children array<string>, synonyms array<string>, labels array<string>")
        out = {r.concept_code: r for r in knowledge.query(rows, ["mi", "nell", "envo"], knowledge.Sources({"mi": words})).collect()}
    assert out["a"].parents == ["p", "1", "p2"] and out["a"].synonyms == ["s"] and out["a"].labels == [] and out["b"].parents == []
    assert out["a"].source_error == "nell,envo"


def test_sampling(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "i int, pos boolean")
    got = sampling.balanced(rows, 20, [sampling.hash_key(["i"]), F.col("i")], F.col("pos"))
    assert got.where("pos").count() == 20 and got.where("not pos").count() == 20
    assert sampling.fraction(rows, "small", [F.col("i")]).count() == 40 and sampling.fraction(rows, "full", []).count() == 100
    s, t = (spark.createDataFrame([(f"{c}{i}",) for i in range(9)], f"{c} string") for c in "st")
    seen = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(9)], "s string, t string")
    assert sampling.negatives(s, t, seen).count() == 72
    assert sampling.negatives(s, t, seen, [F.col("s"), F.col("t")], 10).count() == 10
    edges = spark.createDataFrame([("p", str(i)) for i in range(5)] + [("q", "x")], "parent string, child string")
    kept, rest = sampling.expansion_split(edges, [F.col("child")])
    assert kept.count() == 3 and rest.count() == 3
