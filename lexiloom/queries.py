"""Every operator over the driver's tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .functions import vectors as vec
from .operators import agents, embed, forest, graph, knowledge, levels, metrics, refine, sampling, triples, vectors
from .plans import evaluation
from .sources import alignments, dictionary, predictions, rdf
from .storage import shared_dir, step, step_path, table
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared inputs

LINEITEM_ID = "concat('L', l_orderkey, '-', l_linenumber)"
EDGES_SQL = """
hedges AS (
  SELECT concat('R', n_regionkey) AS parent, concat('N', n_nationkey) AS child FROM nation
  UNION SELECT concat('N', c_nationkey), concat('C', c_custkey) FROM customer
  UNION SELECT concat('N', s_nationkey), concat('S', s_suppkey) FROM supplier
  UNION SELECT concat('C', o_custkey), concat('O', o_orderkey) FROM orders
  UNION SELECT concat('O', l_orderkey), concat('L', l_orderkey, '-', l_linenumber) FROM lineitem
  UNION SELECT concat('P', l_partkey), concat('L', l_orderkey, '-', l_linenumber) FROM lineitem
  UNION SELECT concat('S', l_suppkey), concat('L', l_orderkey, '-', l_linenumber) FROM lineitem)"""
TOP_EDGES_SQL = """
tedges AS (
  SELECT concat('R', n_regionkey) AS parent, concat('N', n_nationkey) AS child FROM nation
  UNION SELECT concat('N', c_nationkey), concat('C', c_custkey) FROM customer
  UNION SELECT concat('N', s_nationkey), concat('S', s_suppkey) FROM supplier)"""


def _edges(spark: SparkSession, d: str, leaves: bool = True) -> DataFrame:
    t = lambda n: table(spark, d, n)
    e = lambda df, a, b: df.selectExpr(f"{a} as parent", f"{b} as child")
    parts = [
        e(t("nation"), "concat('R', n_regionkey)", "concat('N', n_nationkey)"),
        e(t("customer"), "concat('N', c_nationkey)", "concat('C', c_custkey)"),
        e(t("supplier"), "concat('N', s_nationkey)", "concat('S', s_suppkey)"),
    ]
    if not leaves:
        return forest.union(parts).distinct()
    line = t("lineitem")
    below = [(t("orders"), "C", ["o_custkey"], "concat('O', o_orderkey)", ["o_orderkey"])]
    below += [(line, x, [key], LINEITEM_ID, ["l_orderkey", "l_linenumber"]) for x, key in (("O", "l_orderkey"), ("P", "l_partkey"), ("S", "l_suppkey"))]
    known = []
    for rows, x, parent, child, keys in below:
        # the numbers say which edges are the same, and are far less to shuffle than names; without one of them a name is null
        keys = list(dict.fromkeys(parent + keys))
        null = " OR ".join(f"{k} IS NULL" for k in keys)
        known.append(e(rows.where(f"NOT ({null})").select(*keys).distinct(), f"concat('{x}', {parent[0]})", child))
        parts.append(e(rows.where(null), f"concat('{x}', {parent[0]})", child))
    return forest.union([*known, forest.union(parts).distinct()])


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """The upper hierarchy as triples: regions, nations, customers and suppliers, with labels, types and some flags."""
    t = lambda n: table(spark, d, n)
    row = lambda df, s, p, o, lang="''": df.selectExpr("'tpch' as graph", f"{s} as s", f"'{p}' as p", f"{o} as o", f"{lang} as lang")
    parts = []
    for name, key, label in (("region", "concat('R', r_regionkey)", "r_name"), ("nation", "concat('N', n_nationkey)", "n_name"), ("customer", "concat('C', c_custkey)", "c_name"), ("supplier", "concat('S', s_suppkey)", "s_name")):
        parts += [row(t(name), key, triples.LABEL, label), row(t(name), key, triples.TYPE, f"'{triples.OWL}Class'")]
    parts += [row(_edges(spark, d, False), "child", triples.SUB, "parent")]
    parts += [row(t("customer").where("c_acctbal < 0"), "concat('C', c_custkey)", f"{triples.OWL}deprecated", "'true'")]
    parts += [row(t("customer"), "concat('C', c_custkey)", f"{triples.SKOS}altLabel", "c_mktsegment", "if(c_custkey % 2 = 0, 'en', 'de')")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as responses of agents: pair_id, seq, response."""
    events = table(spark, d, "events")
    said = "if(event_type < 'm', 'Yes', ' no ')"
    number = "cast(floor(value) % 14 as int)"
    return events.selectExpr("user_id as pair_id", "event_id", f"concat('x <ANSWER>', {said}, '</answer> <confidence> ', {number}, '</confidence>') as response").withColumn(
        "seq", F.row_number().over(Window.partitionBy("pair_id").orderBy("event_id"))
    )


ANSWERS_SQL = """
answers AS (SELECT user_id AS pair_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
  CASE WHEN event_type < 'm' THEN 1 ELSE 0 END AS ans,
  CASE WHEN CAST(floor(value) AS BIGINT) % 14 BETWEEN 0 AND 10 THEN CAST(CAST(floor(value) AS BIGINT) % 14 AS INTEGER) ELSE 0 END AS conf FROM events)"""


# ---- sources


@query("""SELECT CAST(p_partkey AS VARCHAR) AS src_code, concat('http://ex.org/a#', p_partkey) AS src_uri, p_name AS tgt_code, '' AS tgt_uri,
  CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS label FROM part""")
def S1_alignment(spark, d):
    raw = table(spark, d, "part").selectExpr("cast(p_partkey as string) as source", "concat('http://ex.org/a#', p_partkey) as source_uri", "p_name as target", "if(p_size % 2 = 0, ' 1', '0 ') as Relation")
    return alignments.pairs(raw).selectExpr("src.code as src_code", "src.uri as src_uri", "tgt.code as tgt_code", "tgt.uri as tgt_uri", "label")


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS z, unnest(CASE WHEN p_size % 5 = 0 THEN [p_partkey] ELSE [p_partkey, p_partkey + 1, p_size] END) AS x FROM part)
SELECT concat('C', k) AS src_code, concat('D', x) AS tgt_code, concat('http://ex.org/d#D', x) AS tgt_uri,
  CASE WHEN x = k AND z % 3 = 0 THEN '1' ELSE '0' END AS label FROM c""")
def S2_candidates(spark, d):
    one = "concat(\"'http://ex.org/d#D\", {}, \"'\")"
    cands = f"if(p_size % 5 = 0, '[]', concat('[', {one.format('p_partkey')}, ', ', {one.format('p_partkey + 1')}, ', ', {one.format('p_size')}, ']'))"
    raw = table(spark, d, "part").selectExpr(
        "concat(' C', p_partkey) as src_code", "concat('http://ex.org/n#C', p_partkey) as src_ety", "concat('D', p_partkey) as tgt_code",
        "concat('http://ex.org/d#D', p_partkey, ' ') as tgt_ety", f"{cands} as tgt_cands", "if(p_size % 3 = 0, '1', '0.5') as score",
    )
    return alignments.candidate_pairs(raw).selectExpr("src.code as src_code", "tgt.code as tgt_code", "tgt.uri as tgt_uri", "label")


@query("SELECT DISTINCT p_brand AS code, p_type AS uri FROM part")
def S3_nodes(spark, d):
    raw = table(spark, d, "part").selectExpr("p_name as source", "'' as source_uri", "p_brand as target", "p_type as target_uri")
    return alignments.nodes(alignments.pairs(raw), "tgt")


@query(f"""WITH {TOP_EDGES_SQL} SELECT parent, child FROM tedges""")
def S4_hierarchy(spark, d):
    return rdf.hierarchy(_triples(spark, d))[1]


OWL_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE rdf:RDF [ <!ENTITY ex "http://ex.org/o#"> ]>\n<rdf:RDF xml:base="http://ex.org/o"'
    f' xmlns:rdf="{rdf.RDF}" xmlns:rdfs="{rdf.RDFS}" xmlns:owl="{rdf.OWL}">'
)


@query("""SELECT concat('http://ex.org/o#R', n_regionkey) AS parent, concat('http://ex.org/o#N', n_nationkey) AS child FROM nation
UNION ALL SELECT concat('http://ex.org/o#N', c_nationkey), concat('http://ex.org/o#C', c_custkey) FROM customer
UNION ALL SELECT concat('http://ex.org/o#C', o_custkey), concat('http://ex.org/o#O', o_orderkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def S4_owl_documents(spark, d):
    """Regions to orders written as OWL documents, one a task, and the hierarchy read back from the files in ranges."""
    t = lambda n: table(spark, d, n)
    parts = [
        t("region").selectExpr("concat('R', r_regionkey) as id", "cast(null as string) as parent", "r_name as said"), t("nation").selectExpr("concat('N', n_nationkey) as id", "concat('R', n_regionkey) as parent", "n_name as said"),
        t("customer").selectExpr("concat('C', c_custkey) as id", "concat('N', c_nationkey) as parent", "c_name as said"), t("orders").selectExpr("concat('O', o_orderkey) as id", "concat('C', o_custkey) as parent", "o_orderpriority as said"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("said", F.expr("replace(replace(coalesce(said, ''), '&', '&amp;'), '<', '&lt;')"))
    above = "if(parent is null, '', concat('<rdfs:subClassOf rdf:resource=\"#', parent, '\"/>'))"
    element = f"concat('<owl:Class rdf:about=\"&ex;', id, '\"><rdfs:label xml:lang=\"en\">', said, '</rdfs:label>', {above}, '<!-- <owl:Class> --></owl:Class>') as value"

    def framed(batches):
        yield pa.RecordBatch.from_pydict({"value": [OWL_HEAD]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</rdf:RDF>"]})

    path = step_path(spark, "owl")
    rows.selectExpr(element).mapInArrow(framed, "value string").write.text(path)
    return rdf.hierarchy(step(rdf.read_owl(spark, path), "triples"))[1]


@query("""SELECT page_id, CASE WHEN url LIKE '%#%' THEN string_split(url, '#')[-1] ELSE lower(string_split(rtrim(url, '/'), '/')[-1]) END AS name FROM pages""")
def S5_uri_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.uri_name(F.col("url")).alias("name"))


@query("""SELECT p_brand AS concept_code, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS parents, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS labels FROM part GROUP BY p_brand""")
def S6_A3_dictionary_merge(spark, d):
    none = "cast(array() as array<string>)"
    rows = table(spark, d, "part").selectExpr("p_brand as concept_code", "array(p_type) as parents", f"{none} as children", f"{none} as synonyms", "array(p_name, null) as labels")
    return dictionary.merge(rows).select("concept_code", F.array_join("parents", "|").alias("parents"), F.array_join("labels", "|").alias("labels"))


@query("""SELECT CAST(user_id AS VARCHAR) AS source, event_type AS target, CAST(arg_min(CAST(floor(value) AS INTEGER), event_id) AS INTEGER) AS confidence FROM events GROUP BY user_id, event_type""")
def S8_first_predictions(spark, d):
    events = table(spark, d, "events")
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target"), F.floor("value").cast("int").alias("confidence")))
    good = events.select((F.col("event_id") * 3).alias("line"), record.alias("value"))
    blank = events.select((F.col("event_id") * 3 + 1).alias("line"), F.lit("  ").alias("value"))
    bad = events.select((F.col("event_id") * 3 + 2).alias("line"), F.concat(F.lit("{\"source\": "), record).alias("value"))
    return predictions.first_records(good.unionByName(blank).unionByName(bad)).select("source", "target", "confidence")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source, lang AS target, quality AS true_relation, 1 - toxic AS pred_relation FROM labels JOIN documents USING (doc_id)""")
def O1_prediction_sink(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    records = rows.selectExpr(
        "quality", "'' as source_label", "'' as target_label", "cast(doc_id as string) as source", "'' as source_uri", "lang as target", "'' as target_uri", "0.5D as similarity", "7 as confidence",
        "cast(quality as int) as true_relation", "cast(1 - toxic as int) as pred_relation", "named_struct('input_token', 1L, 'output_token', 2L, 'api_calls', 1L) as api_metrics", "true as accepted",
    )
    path = step_path(spark, "sink")
    for part in (0, 1, 0):  # the first batch is tried again
        predictions.append_predictions(records.where(F.col("quality") == part).drop("quality"), path, part)
    return predictions.read_predictions(spark, path).select("source", "target", "true_relation", "pred_relation")


# ---- projections, filters, text functions


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '[_\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿]')) AS x FROM documents)
SELECT doc_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, ', ')) AS hash FROM w""")
def P2_clean_terms(spark, d):
    kept = text.clean_terms(F.split("text", " ", -1))
    return table(spark, d, "documents").select("doc_id", kept.alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", ", ")).alias("hash"))


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)")
def P3_P4_unseen(spark, d):
    return sampling.unseen(table(spark, d, "embeddings").select("vec_id"), table(spark, d, "labels").selectExpr("doc_id as vec_id"), ["vec_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def P5_having(spark, d):
    return sampling.having(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


F1_SQL = r"""WITH p AS (SELECT page_id, u, generate_subscripts(string_split(v, '|'), 1) AS i, unnest(string_split(v, '|')) AS x FROM (SELECT page_id, url AS u, concat(url, '|DOID:', page_id, '|http://x.org#T', page_id) AS v FROM pages)),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '#.*$', ''), '\?.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*', ''), ';[^/]*$', '') AS path FROM p),
b AS (SELECT *, string_split(rtrim(path, '/'), '/')[-1] AS seg FROM a)
SELECT page_id, string_agg(string_split(CASE WHEN seg <> '' THEN seg ELSE x END, '#')[-1], ',' ORDER BY i) AS terms FROM b GROUP BY page_id"""


@query(F1_SQL)
def F1_F2_clean_uris(spark, d):
    values = F.array(F.expr("concat(url, '|DOID:', page_id, '|http://x.org#T', page_id)"))
    return table(spark, d, "pages").select("page_id", F.array_join(text.strip_path(text.clean_uris(values)), ",").alias("terms"))


@query(f"""WITH {ANSWERS_SQL} SELECT pair_id, CAST(seq AS INTEGER) AS seq, ans, conf, CAST(2 * conf - 11 AS DOUBLE) AS gate, 2 * conf > 11 AS accepted FROM answers""")
def F4_F5_F6_parse_gate(spark, d):
    rows = _answers(spark, d).select("pair_id", "seq", text.yes_no(F.col("response")).alias("ans"), text.confidence(F.col("response")).alias("conf"))
    gate = text.gate_score(F.col("conf"))
    return rows.select("*", gate.alias("gate"), (gate > 0).alias("accepted"))


@query("""SELECT event_id, CASE WHEN contains(lower(event_type), 'syn') THEN 'synonym' WHEN contains(lower(event_type), 'classof') THEN 'parent' ELSE 'child' END AS plain,
CASE WHEN event_id % 3 = 0 THEN 'synonym' WHEN event_id % 3 = 1 THEN 'parent' ELSE 'child' END AS kind FROM events""")
def F13_relation_kind(spark, d):
    made = F.expr("case event_id % 3 when 0 then 'Synonym' when 1 then 'subClassOf' else 'RelatedTo' end")
    return table(spark, d, "events").select("event_id", text.relation_kind(F.col("event_type")).alias("plain"), text.relation_kind(made).alias("kind"))


@query("SELECT conv_id, turn, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM conversations")
def F9_token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


F10_SQL = """WITH RECURSIVE m AS (SELECT conv_id, coalesce(text, '') AS text, length(coalesce(text, '')) // 4 AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT conv_id, n + 1 AS pos, n, tokens AS used, true AS fits FROM m WHERE pos = 1
  UNION ALL SELECT m.conv_id, m.pos, m.n, w.used + CASE WHEN w.used + m.tokens <= 250 THEN m.tokens ELSE 0 END, w.used + m.tokens <= 250 FROM w JOIN m ON m.conv_id = w.conv_id AND m.pos = w.pos - 1 AND m.pos > 1),
k AS (SELECT m.conv_id, 2 * m.pos AS o, m.text FROM m JOIN w ON w.conv_id = m.conv_id AND w.pos = m.pos AND w.fits WHERE m.pos > 1 UNION ALL SELECT conv_id, 2, text FROM m WHERE pos = 1
  UNION ALL SELECT conv_id, 3, '%s' FROM w GROUP BY conv_id HAVING bool_or(NOT fits))
SELECT conv_id, CAST(count(*) AS INTEGER) AS kept, md5(string_agg(text, chr(10) ORDER BY o)) AS hash FROM k GROUP BY conv_id""" % agents.NOTICE.replace("'", "''")


@query(F10_SQL)
def F10_truncate(spark, d):
    rows = table(spark, d, "conversations")
    done = agents.truncate(rows, "conv_id", "turn", total=400, reply=150)
    return done.select("conv_id", F.size("messages").alias("kept"), F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "\n")).alias("hash"))


# ---- joins, aggregates, windows


@query("""SELECT n_name AS s, r_name AS t FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey""")
def J4_negatives(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    seen = n.join(r, n.n_regionkey == r.r_regionkey).selectExpr("n_name as s", "r_name as t")
    return sampling.negatives(n.selectExpr("n_name as s"), r.selectExpr("r_name as t"), seen)


A1_SQL = """WITH c AS (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN quality <> 1 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
CAST(sum(CASE WHEN quality = 1 AND toxic <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM labels)
SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"""


@query(A1_SQL)
def A1_scores(spark, d):
    rows = table(spark, d, "labels").selectExpr("quality as true_relation", "1 - toxic as pred_relation")
    return metrics.score(rows).select(*[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


@query("""WITH c AS (SELECT doc_id, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END) OVER w AS tp, sum(CASE WHEN quality <> 1 AND toxic = 0 THEN 1.0 ELSE 0 END) OVER w AS fp,
sum(CASE WHEN quality = 1 AND toxic <> 0 THEN 1.0 ELSE 0 END) OVER w AS fn FROM labels WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT doc_id, CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce(fp, 0) AS DOUBLE) AS fp, CAST(coalesce(fn, 0) AS DOUBLE) AS fn FROM c)
SELECT doc_id, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0.0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0.0 END AS f1 FROM z""")
def W1_running_scores(spark, d):
    rows = table(spark, d, "labels").selectExpr("doc_id", "quality as true_relation", "1 - toxic as pred_relation")
    out = metrics.running_score(rows, "doc_id", buckets=7)
    return out.select("doc_id", *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


@query(f"""WITH {ANSWERS_SQL}, g AS (SELECT pair_id, ans, count(*) AS n, min(seq) AS first, sum(conf) AS s FROM answers GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, first) AS nth FROM g)
SELECT pair_id, ans AS pred, CAST(floor(s / n) AS INTEGER) AS confidence FROM r WHERE nth = 1""")
def A2_vote(spark, d):
    rows = _answers(spark, d).select("pair_id", "seq", text.yes_no(F.col("response")).alias("ans"), text.confidence(F.col("response")).alias("conf"))
    return agents.vote(rows)


@query("""SELECT concat('N', n_nationkey) AS id, concat('R', n_regionkey) AS parents FROM nation
UNION ALL SELECT concat('R', r_regionkey), NULL FROM region WHERE false""")
def A4_parent_map(spark, d):
    edges = table(spark, d, "nation").selectExpr("concat('R', n_regionkey) as parent", "concat('N', n_nationkey) as child")
    return knowledge.parent_child_maps(edges)[0].select("id", F.array_join("parents", "|").alias("parents"))


@query("SELECT concat('R', n_regionkey) AS id, string_agg(concat('N', n_nationkey), '|' ORDER BY concat('N', n_nationkey)) AS children FROM nation GROUP BY n_regionkey")
def A4_child_map(spark, d):
    edges = table(spark, d, "nation").selectExpr("concat('R', n_regionkey) as parent", "concat('N', n_nationkey) as child")
    return knowledge.parent_child_maps(edges)[1].select("id", F.array_join("children", "|").alias("children"))


@query("""WITH a AS (SELECT event_type, CAST(user_id AS VARCHAR) AS term, max(greatest(value, 0)) AS w, min(event_id) AS seq FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY w DESC, seq, term) AS nth FROM a)
SELECT event_type, string_agg(term, ',' ORDER BY nth) AS terms FROM r WHERE nth <= 5 GROUP BY event_type""")
def A5_T2_best_terms(spark, d):
    rows = table(spark, d, "events").selectExpr("event_type", "cast(user_id as string) as term", "value as weight", "event_id as seq")
    return knowledge.best_terms(rows, ["event_type"]).select("event_type", F.array_join("terms", ",").alias("terms"))


@query("""SELECT role, CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS input_token, CAST(sum(turn) AS BIGINT) AS output_token, count(*) AS api_calls FROM conversations GROUP BY role""")
def A7_usage(spark, d):
    rows = table(spark, d, "conversations").select("role", text.token_estimate(F.col("text")).alias("input_token"), F.col("turn").alias("output_token"), F.lit(1).alias("api_calls"))
    return metrics.usage(rows, ["role"])


@query("""WITH u AS (SELECT role, conv_id, turn, CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'o3-mini' ELSE 'none' END AS model, length(coalesce(text, '')) // 4 AS i, turn AS o FROM conversations),
p AS (SELECT * FROM (VALUES ('gpt-4o', 2.5, 10.0), ('o3-mini', 1.1, 4.4)) v(model, a, b)),
c AS (SELECT u.*, (i * coalesce(a, 0) + o * coalesce(b, 0)) / 1e6 AS cost FROM u LEFT JOIN p USING (model))
SELECT model, round(CAST(sum(cost) AS DOUBLE), 6) AS total_cost, count(*) AS api_calls, round(CAST(arg_max(cost, conv_id * 1000 + turn) AS DOUBLE), 9) AS last_cost FROM c GROUP BY model""")
def J8_A8_cost(spark, d):
    rows = table(spark, d, "conversations").select(
        F.lit("openai").alias("backend"), F.expr("case role when 'user' then 'gpt-4o' when 'assistant' then 'o3-mini' else 'none' end").alias("model"),
        text.token_estimate(F.col("text")).alias("input_token"), F.col("turn").alias("output_token"), F.expr("conv_id * 1000 + turn").alias("at"),
    )
    out = metrics.cost(rows, metrics.price_table(spark), ["model"], "at")
    return out.select("model", F.round("total_cost", 6).alias("total_cost"), "api_calls", F.round("last_cost", 9).alias("last_cost"))


# ---- samples, top-k


@query("""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality = 1 ORDER BY (doc_id * 7919 + 13) % 10007, doc_id) AS n FROM labels) WHERE n <= 30""")
def T5_balanced_sample(spark, d):
    order = [F.expr("(doc_id * 7919 + 13) % 10007"), F.col("doc_id")]
    return sampling.balanced(table(spark, d, "labels").select("doc_id", "quality"), 30, order, F.col("quality") == 1)


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919 + 13) % 10007, doc_id) AS n, count(*) OVER () AS c FROM documents) WHERE n <= floor(c * 0.4)""")
def T6_fraction(spark, d):
    return sampling.fraction(table(spark, d, "documents").select("doc_id"), "small", [F.expr("(doc_id * 7919 + 13) % 10007"), F.col("doc_id")])


@query("""SELECT doc_id FROM (SELECT * FROM labels ORDER BY (doc_id * 7919 + 13) % 10007, doc_id LIMIT 5) WHERE quality = 1 - toxic""")
def T7_demonstrations(spark, d):
    rows = table(spark, d, "labels").selectExpr("doc_id", "quality as true_relation", "1 - toxic as pred_relation")
    return sampling.demonstrations(rows, [F.expr("(doc_id * 7919 + 13) % 10007"), F.col("doc_id")]).select("doc_id")


@query("""SELECT parent, child FROM (SELECT concat('N', c_nationkey) AS parent, c_custkey AS child, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919 + 13) % 10007, c_custkey) AS n,
count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer) WHERE n <= greatest(1, floor(c * 0.5))""")
def T8_expansion_split(spark, d):
    edges = table(spark, d, "customer").selectExpr("concat('N', c_nationkey) as parent", "c_custkey as child")
    return sampling.expansion_split(edges, [F.expr("(child * 7919 + 13) % 10007"), F.col("child")])[0]


@query("""WITH r AS (SELECT a.vec_id AS query_id, b.vec_id AS ext_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s FROM embeddings a CROSS JOIN embeddings b),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ext_id) AS nth FROM r)
SELECT query_id, ext_id, round(s, 6) AS similarity, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 3""")
def V2_T3_cosine_top_k(spark, d):
    e = table(spark, d, "embeddings")
    hits = vectors.top_k(e.selectExpr("vec_id as query_id", "embedding"), e.selectExpr("vec_id as ext_id", "embedding"), 3)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("""SELECT a.vec_id AS vec_id, CAST(a.vec_id AS VARCHAR) AS text, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
CAST(len(a.embedding) + len(b.embedding) AS INTEGER) AS joined, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * 0.25 + CAST(z[2] AS DOUBLE) * 0.75)), 6) AS weighted
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def V3_V4_V9_pairs(spark, d):
    e = table(spark, d, "embeddings")
    both = e.selectExpr("vec_id", "embedding as a").join(e.selectExpr("vec_id - 1 as vec_id", "embedding as b"), "vec_id")
    a, b = F.col("a"), F.col("b")
    return both.select(
        "vec_id", vec.external_id(F.col("vec_id")).alias("text"), F.round(vec.cosine(a, b), 6).alias("similarity"), F.size(vec.combine(a, b)).alias("joined"),
        F.round(F.aggregate(vec.combine(a, b, "weighted", 0.25), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"),
    )


@query("""WITH r AS (SELECT a.vec_id AS q, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, b.vec_id) AS nth
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
c AS (SELECT CAST(sum(CASE WHEN la = lb THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS n FROM r WHERE nth <= 3)
SELECT round(tp / n, 9) AS precision, CASE WHEN tp > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recall, round(2 * tp / (tp + n), 9) AS f1 FROM c""")
def V2_A1_neighbour_label(spark, d):
    e = table(spark, d, "embeddings")
    hits = vectors.top_k(e.selectExpr("vec_id as query_id", "embedding"), e.selectExpr("vec_id as ext_id", "embedding"), 3, exclude_self=True)
    both = hits.join(e.selectExpr("vec_id as query_id", "label as a"), "query_id").join(e.selectExpr("vec_id as ext_id", "label as b"), "ext_id")
    return metrics.score(both.select(F.when(F.col("a") == F.col("b"), 1).otherwise(0).alias("true_relation"), F.lit(1).alias("pred_relation"))).select(*[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


# ---- knowledge


@query("""WITH x AS (SELECT p_brand AS concept_code, list_sort(list(DISTINCT p_type))[1:3] AS parents, list_sort(list(DISTINCT p_name))[1:3] AS labels FROM part GROUP BY 1)
SELECT concept_code, array_to_string(parents, '|') AS parents, array_to_string(labels, '|') AS labels, 'wordnet' AS source_error FROM x""")
def K1_K2_dictionary_query(spark, d):
    none = "cast(array() as array<string>)"
    rows = table(spark, d, "part").selectExpr("p_brand as concept_code", "array(concat('http://x.org/t/', p_type, '/#f')) as parents", f"{none} as children", f"{none} as synonyms", "array(p_name) as labels")
    own = knowledge.Sources({"envo": dictionary.merge(rows)})
    out = knowledge.query(rows, ["envo", "wordnet", "envo"], own)
    return out.select("concept_code", F.array_join("parents", "|").alias("parents"), F.array_join("labels", "|").alias("labels"), "source_error")


@query("""WITH e AS (SELECT event_type AS concept, concat('u', user_id) AS s, concat('v', event_id % 97) AS t, event_id AS seq, greatest(value, 0) AS w, event_id % 3 AS k, value > 50 AS near FROM events),
a AS (SELECT concept, k, CASE WHEN near THEN s ELSE t END AS term, max(w) AS w, min(seq) AS seq FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY concept, k ORDER BY w DESC, seq, term) AS nth FROM a),
c AS (SELECT concept, string_agg(term, '|' ORDER BY nth) FILTER (WHERE k = 1) AS parents, string_agg(term, '|' ORDER BY nth) FILTER (WHERE k = 2) AS children, string_agg(term, '|' ORDER BY nth) FILTER (WHERE k = 0) AS synonyms FROM r WHERE nth <= 5 GROUP BY concept)
SELECT concept AS concept_code, coalesce(parents, '') AS parents, coalesce(children, '') AS children, coalesce(synonyms, '') AS synonyms, concept AS labels FROM c""")
def K4_edge_terms(spark, d):
    events = table(spark, d, "events")
    edges = events.selectExpr(
        "event_type as concept", "concat('U', user_id) as start_label", "concat('V', event_id % 97) as end_label",
        "case event_id % 3 when 0 then 'Synonym' when 1 then 'SubClassOf' else 'RelatedTo' end as rel_label", "value as weight", "event_id as seq",
    )
    concepts = events.selectExpr("event_type as concept_code").distinct()
    lexicon = events.selectExpr("event_type as word").distinct()
    like = lambda rows: rows.withColumn("sim_start", F.col("weight")).withColumn("sim_end", F.lit(50.0))
    out = knowledge.edge_terms(concepts, edges, lexicon, like)
    return out.select("concept_code", *[F.array_join(k, "|").alias(k) for k in ("parents", "children", "synonyms", "labels")])


@query(f"""WITH {TOP_EDGES_SQL}, i AS (SELECT DISTINCT child AS id FROM tedges UNION SELECT parent FROM tedges),
p AS (SELECT child AS id, string_agg(parent, '|' ORDER BY parent) AS parents FROM tedges GROUP BY 1), c AS (SELECT parent AS id, string_agg(child, '|' ORDER BY child) AS children FROM tedges GROUP BY 1)
SELECT id AS concept_code, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM i LEFT JOIN p USING (id) LEFT JOIN c USING (id)""")
def K5_K7_ontology(spark, d):
    edges = _edges(spark, d, False)
    nodes = graph.nodes_of(None, edges).withColumnRenamed("id", "concept_code")
    out = knowledge.query(nodes, ["ontology"], knowledge.Sources(edges=edges))
    return out.select("concept_code", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"))


@query("""WITH m AS (SELECT p_brand AS code, array_to_string(list_sort(list(DISTINCT p_type))[1:3], '|') AS parents FROM part GROUP BY 1)
SELECT p_partkey, a.parents AS src_parents, coalesce(b.parents, '') AS tgt_parents FROM part LEFT JOIN m a ON a.code = p_brand LEFT JOIN m b ON b.code = p_name""")
def J1_K8_enrich(spark, d):
    part = table(spark, d, "part")
    rows = part.selectExpr("p_partkey", "named_struct('code', p_brand, 'uri', '') as src", "named_struct('code', p_name, 'uri', '') as tgt", "'1' as label")
    none = "cast(array() as array<string>)"
    words = dictionary.merge(part.selectExpr("p_brand as concept_code", "array(p_type) as parents", f"{none} as children", f"{none} as synonyms", f"{none} as labels"))
    meta = step(knowledge.enrich(rows, ["mouse"], knowledge.Sources({"mouse": words})), "meta")
    out = knowledge.with_metadata(rows, meta)
    return out.select("p_partkey", F.array_join("src_meta.parents", "|").alias("src_parents"), F.array_join("tgt_meta.parents", "|").alias("tgt_parents"))


# ---- graph patterns


@query(f"""WITH RECURSIVE {TOP_EDGES_SQL}, c AS (SELECT parent AS start, child AS id FROM tedges WHERE parent LIKE 'R%' UNION SELECT c.start, e.child FROM c JOIN tedges e ON e.parent = c.id) SELECT start, id FROM c""")
def R2_descendants(spark, d):
    start = table(spark, d, "region").selectExpr("concat('R', r_regionkey) as id")
    return triples.descendants(_triples(spark, d), start)


@query(f"""WITH RECURSIVE {TOP_EDGES_SQL}, c AS (SELECT concat('S', s_suppkey) AS start, concat('S', s_suppkey) AS id FROM supplier UNION SELECT c.start, e.parent FROM c JOIN tedges e ON e.child = c.id) SELECT start, id FROM c""")
def R3_R4_ancestors_self(spark, d):
    start = table(spark, d, "supplier").selectExpr("concat('S', s_suppkey) as id")
    return triples.ancestors(_triples(spark, d), start, include_self=True)


@query("""SELECT concat('C', c_custkey) AS id, c_name AS label, c_mktsegment AS alt, c_acctbal < 0 AS deprecated FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_custkey % 2 = 0""")
def R1_R5_R9_R11_patterns(spark, d):
    t = triples.from_graph(_triples(spark, d), "tpch")
    alt = triples.with_language(t.where(F.col("p") == f"{triples.SKOS}altLabel"), "en").selectExpr("s as id", "o as alt")
    rows = triples.pattern(t, "id", triples.LABEL, "label").join(alt, "id").join(triples.values(spark, "alt", ["BUILDING", "AUTOMOBILE"]), "alt")
    return triples.exists(rows, triples.pattern(t, "id", f"{triples.OWL}deprecated", F.lit("true")), ["id"], "deprecated").select("id", "label", "alt", "deprecated")


@query("""SELECT concat('C', c_custkey) AS id, o_orderkey AS orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'""")
def R6_optional(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("concat('C', o_custkey) as id", "o_orderkey as orderkey")
    return triples.optional(table(spark, d, "customer").selectExpr("concat('C', c_custkey) as id"), o, ["id"])


@query("""SELECT p_brand, string_agg(concat(p_type, '=', p_name), ' | ' ORDER BY concat(p_type, '=', p_name)) AS annotations FROM part GROUP BY p_brand""")
def R7_R8_A10_group_concat(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.concat("p_type", F.lit("="), "p_name").alias("annot"))
    return triples.group_concat(rows, ["p_brand"], "annot", "annotations")


@query("""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(a|b|p)') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') ORDER BY p_name, p_partkey LIMIT 500""")
def R10_R13_not_exists(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name").where(F.col("p_name").rlike("^(a|b|p)"))
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey as p_partkey").distinct()
    return triples.not_exists(rows, seen, ["p_partkey"]).orderBy("p_name", "p_partkey").limit(500)


@query(f"""WITH RECURSIVE {TOP_EDGES_SQL}, up AS (SELECT child AS start, parent AS id FROM tedges UNION SELECT up.start, e.parent FROM up JOIN tedges e ON e.child = up.id),
l AS (SELECT concat('R', r_regionkey) AS id, r_name AS label FROM region UNION ALL SELECT concat('N', n_nationkey), n_name FROM nation)
SELECT start AS concept_code, string_agg(lower(label), '|' ORDER BY label, id) AS parents FROM up JOIN l USING (id) WHERE start LIKE 'S%' OR start LIKE 'C%' GROUP BY start""")
def S9_K3_ncit_parents(spark, d):
    t = _triples(spark, d)
    moved = t.select("graph", F.when(F.col("s").rlike("^[RNCS][0-9]"), F.concat(F.lit(triples.NCIT), "s")).otherwise(F.col("s")).alias("s"), "p", F.when((F.col("p") == triples.SUB), F.concat(F.lit(triples.NCIT), "o")).otherwise(F.col("o")).alias("o"), "lang")
    people = table(spark, d, "supplier").selectExpr("concat('S', s_suppkey) as concept_code").unionByName(table(spark, d, "customer").selectExpr("concat('C', c_custkey) as concept_code"))
    return triples.ncit_terms(step(moved, "triples"), people).select("concept_code", F.array_join("parents", "|").alias("parents"))


@query(f"""WITH kids AS (SELECT concat('N', c_nationkey) AS code, concat('C', c_custkey) AS kid, c_mktsegment AS alt, c_custkey % 2 = 0 AS en FROM customer),
ch AS (SELECT code, lower(concat('{triples.DBO}', kid)) AS term, row_number() OVER (PARTITION BY code ORDER BY kid) AS nth FROM kids),
al AS (SELECT code, lower(alt) AS term, row_number() OVER (PARTITION BY code ORDER BY kid) AS nth FROM kids WHERE en),
al1 AS (SELECT code, term, min(nth) AS first FROM al WHERE nth <= 10 GROUP BY code, term),
al2 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY first) AS nth FROM al1),
chs AS (SELECT code, string_agg(term, '|' ORDER BY nth) AS children FROM ch WHERE nth <= 3 GROUP BY code),
als AS (SELECT code, string_agg(term, '|' ORDER BY nth) AS synonyms FROM al2 WHERE nth <= 3 GROUP BY code)
SELECT concat('N', n_nationkey) AS concept_code, '' AS parents, coalesce(children, '') AS children, coalesce(synonyms, '') AS synonyms, '' AS labels
FROM nation LEFT JOIN chs ON chs.code = concat('N', n_nationkey) LEFT JOIN als ON als.code = concat('N', n_nationkey)
UNION ALL SELECT kid, lower(concat('{triples.DBO}', code)), '', '', CASE WHEN en THEN lower(alt) ELSE '' END FROM kids""")
def K3_dbpedia_terms(spark, d):
    """Customers are instances of their nations; even ones have an English other name, odd ones a German one."""
    c = table(spark, d, "customer")
    kid = f"concat('{triples.DBO}C', c_custkey) as s"
    t = c.selectExpr("'' as graph", kid, f"'{triples.TYPE}' as p", f"concat('{triples.DBO}N', c_nationkey) as o", "'' as lang")
    t = t.unionByName(c.selectExpr("'' as graph", kid, f"'{triples.SKOS}altLabel' as p", "c_mktsegment as o", "if(c_custkey % 2 = 0, 'en', 'de') as lang"))
    codes = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as concept_code").unionByName(c.selectExpr("concat('C', c_custkey) as concept_code"))
    out = triples.dbpedia_terms(step(t, "triples"), codes)
    return out.select("concept_code", *[F.array_join(x, "|").alias(x) for x in ("parents", "children", "synonyms", "labels")])


@query("""WITH live AS (SELECT c_custkey, c_nationkey, c_name, c_mktsegment, concat('DOID:C', c_custkey) AS number FROM customer WHERE c_acctbal >= 0 AND c_custkey % 3 <> 0),
own AS (SELECT concat('N', n_nationkey) AS code, concat('DOID:N', n_nationkey) AS number, n_name AS label, n_nationkey FROM nation),
down AS (SELECT code, number, label FROM own UNION ALL SELECT concat('N', c_nationkey), number, c_name FROM live),
dk AS (SELECT code, lower(label) AS term, row_number() OVER (PARTITION BY code ORDER BY number, label) AS nth FROM down),
dt AS (SELECT code, term, min(nth) AS first FROM dk WHERE nth <= 20 GROUP BY code, term),
dn AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY first) AS nth FROM dt),
kids AS (SELECT code, string_agg(term, '|' ORDER BY nth) AS children FROM dn WHERE nth <= 3 GROUP BY code)
SELECT code AS concept_code, lower(label) AS parents, children, '' AS synonyms, lower(label) AS labels FROM own JOIN kids USING (code)
UNION ALL SELECT concat('C', c_custkey), CASE WHEN live THEN lower(concat(c_name, '|', n_name)) ELSE lower(n_name) END, CASE WHEN live THEN lower(c_name) ELSE '' END,
  CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment) ELSE '' END, lower(c_name)
FROM (SELECT *, c_acctbal >= 0 AND c_custkey % 3 <> 0 AS live FROM customer) JOIN nation ON n_nationkey = c_nationkey""")
def K3_doid_terms(spark, d):
    """Customers are subclasses of their nations, deprecated below zero; two of three have a cross reference, all an exact synonym."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    row = lambda df, key, p, o: df.selectExpr("'' as graph", f"concat('{triples.OBO}DOID_', {key}) as s", f"'{p}' as p", f"{o} as o", "'' as lang")
    nk, ck, own = "concat('N', n_nationkey)", "concat('C', c_custkey)", triples.OBO_IN_OWL
    parts = [row(c, ck, triples.SUB, f"concat('{triples.OBO}DOID_N', c_nationkey)"), row(c.where("c_acctbal < 0"), ck, f"{triples.OWL}deprecated", "'true'")]
    parts += [row(n, nk, f"{own}hasDbXref", "'ICD10:x'"), row(c, ck, f"{own}hasDbXref", "if(c_custkey % 3 != 0, 'ICD9:y', 'other:z')"), row(c, ck, f"{own}hasExactSynonym", "c_mktsegment")]
    for df, key, label in ((n, nk, "n_name"), (c, ck, "c_name")):
        parts += [row(df, key, triples.LABEL, label), row(df, key, triples.TYPE, f"'{triples.OWL}Class'"), row(df, key, f"{own}id", f"concat('DOID:', {key})"), row(df, key, f"{own}hasOBONamespace", "'disease_ontology'")]
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    codes = n.selectExpr(f"{nk} as concept_code").unionByName(c.selectExpr(f"{ck} as concept_code"))
    out = triples.doid_terms(step(t, "triples"), codes)
    return out.select("concept_code", *[F.array_join(x, "|").alias(x) for x in ("parents", "children", "synonyms", "labels")])


# ---- graphs


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT DISTINCT parent AS id, 0 AS rank FROM hedges WHERE parent NOT IN (SELECT child FROM hedges)
UNION SELECT e.child, r.rank + 1 FROM r JOIN hedges e ON e.parent = r.id)
SELECT id, CAST(max(rank) AS INTEGER) AS rank FROM r GROUP BY id""")
def G1_ranks(spark, d):
    return graph.ranks(None, _edges(spark, d))


@query(f"""WITH {TOP_EDGES_SQL} SELECT parent, child FROM tedges UNION SELECT concat('C', o_custkey), concat('O', o_orderkey) FROM orders""")
def G2_A6_merge(spark, d):
    a, b = _edges(spark, d, False), table(spark, d, "orders").selectExpr("concat('C', o_custkey) as parent", "concat('O', o_orderkey) as child")
    return graph.merge_graphs((graph.nodes_of(None, a), a), (graph.nodes_of(None, b), b), (graph.nodes_of(None, a), a))[1]


@query(f"""WITH {EDGES_SQL}, n AS (SELECT parent AS id FROM hedges UNION SELECT child FROM hedges) SELECT n.id, count(e.child) AS degree FROM n LEFT JOIN hedges e ON e.child = n.id GROUP BY n.id""")
def A9_in_degree(spark, d):
    edges = _edges(spark, d)
    return graph.in_degree(graph.nodes_of(None, edges), edges)


@query("""WITH e AS (SELECT concat('C', o_custkey) AS parent, concat('O', o_orderkey) AS child FROM orders), b AS (SELECT concat('C', c_custkey) AS id, c_mktsegment AS block FROM customer UNION ALL SELECT concat('O', o_orderkey), o_orderstatus FROM orders),
m AS (SELECT b.id, k.least FROM b JOIN (SELECT block, min(id) AS least FROM b GROUP BY block) k USING (block))
SELECT DISTINCT p.least AS parent, c.least AS child FROM e JOIN m p ON p.id = e.parent JOIN m c ON c.id = e.child WHERE p.least <> c.least""")
def G6_T10_collapse(spark, d):
    o = table(spark, d, "orders")
    edges = o.selectExpr("concat('C', o_custkey) as parent", "concat('O', o_orderkey) as child")
    blocks = table(spark, d, "customer").selectExpr("concat('C', c_custkey) as id", "c_mktsegment as block").unionByName(o.selectExpr("concat('O', o_orderkey) as id", "o_orderstatus as block"))
    return graph.collapse(edges, graph.representatives(blocks))


@query("""WITH e AS (SELECT DISTINCT concat('P', l_partkey) AS parent, concat('S', l_suppkey) AS child FROM lineitem), b AS (SELECT DISTINCT child AS id, concat('n', s_nationkey) AS block FROM e JOIN supplier ON concat('S', s_suppkey) = child),
z AS (SELECT block, count(*) AS size FROM b GROUP BY block), h AS (SELECT e.parent, e.child, b.block FROM e JOIN b ON b.id = e.child),
c AS (SELECT block, parent, count(DISTINCT child) AS n FROM h GROUP BY 1, 2), s AS (SELECT block, min(parent) AS parent FROM c JOIN z USING (block) WHERE n < size GROUP BY block),
m AS (SELECT h.child AS id FROM h JOIN s ON s.block = h.block AND s.parent = h.parent)
SELECT b.id, CASE WHEN b.block IN (SELECT block FROM s) THEN concat(b.block, CASE WHEN b.id IN (SELECT id FROM m) THEN '.1' ELSE '.0' END) ELSE b.block END AS block FROM b""")
def G3_split_once(spark, d):
    edges = table(spark, d, "lineitem").selectExpr("concat('P', l_partkey) as parent", "concat('S', l_suppkey) as child").distinct()
    blocks = edges.select(F.col("child").alias("id")).distinct().join(table(spark, d, "supplier").selectExpr("concat('S', s_suppkey) as id", "concat('n', s_nationkey) as block"), "id")
    return refine.split_once(blocks.withColumn("rank", F.lit(1)), edges, 0).select("id", "block")


RANKS_SQL = f"""{EDGES_SQL}, r AS (SELECT DISTINCT parent AS id, 0 AS rank FROM hedges WHERE parent NOT IN (SELECT child FROM hedges)
UNION SELECT e.child, r.rank + 1 FROM r JOIN hedges e ON e.parent = r.id), rk AS (SELECT id, max(rank) AS rank FROM r GROUP BY id),
b0 AS (SELECT id, rank, CAST(rank AS VARCHAR) AS block FROM rk)"""
NAMED_SQL = "SELECT id, min(id) OVER (PARTITION BY block) AS block FROM"
#: The hierarchy has ranks 0 to 4, so four passes, and five rounds until the partition is stable.
PASS_SQL = """,
h{i} AS MATERIALIZED (SELECT e.parent, e.child, b.block FROM hedges e JOIN rk p ON p.id = e.parent AND p.rank = {i} JOIN b{i} b ON b.id = e.child AND b.rank > {i}),
s{i} AS MATERIALIZED (SELECT block, min(parent) AS parent FROM (SELECT block, parent, count(*) AS n FROM h{i} GROUP BY 1, 2) JOIN (SELECT block, count(*) AS size FROM b{i} GROUP BY 1) USING (block) WHERE n < size GROUP BY block),
m{i} AS (SELECT h.child FROM h{i} h JOIN s{i} s ON s.block = h.block AND s.parent = h.parent),
b{j} AS MATERIALIZED (SELECT b.id, b.rank, CASE WHEN s.block IS NULL THEN b.block WHEN m.child IS NULL THEN concat(b.block, '.0') ELSE concat(b.block, '.1') END AS block
  FROM b{i} b LEFT JOIN s{i} s ON s.block = b.block LEFT JOIN m{i} m ON m.child = b.id)"""
ROUND_SQL = """,
p{i} AS (SELECT e.child AS id, md5(string_agg(DISTINCT b.block, ',' ORDER BY b.block)) AS sig FROM hedges e JOIN b{i} b ON b.id = e.parent GROUP BY e.child),
b{j} AS MATERIALIZED (SELECT b.id, b.rank, md5(concat(b.block, '|', coalesce(p.sig, ''))) AS block FROM b{i} b LEFT JOIN p{i} p ON p.id = b.id)"""


def _unrolled(part: str, times: int) -> str:
    return f"WITH RECURSIVE {RANKS_SQL}{''.join(part.format(i=i, j=i + 1) for i in range(times))} {NAMED_SQL} b{times}"


@query(_unrolled(PASS_SQL, 4))
def G3_offline_refine(spark, d):
    return evaluation.compress(_edges(spark, d))[0]


@query(_unrolled(ROUND_SQL, 6))
def G3_refine_to_fixpoint(spark, d):
    return evaluation.compress(_edges(spark, d), "full")[0]


@query(f"""WITH {EDGES_SQL}, keyed AS (SELECT concat('C', o_custkey) AS c, o_custkey AS ck, concat('O', o_orderkey) AS o FROM orders),
firsts AS (SELECT c, ck, min(o) AS o FROM keyed GROUP BY c, ck),
lines AS (SELECT f.c, f.ck, f.o, min(concat('L', l_orderkey, '-', l_linenumber)) AS l FROM firsts f JOIN lineitem ON concat('O', l_orderkey) = f.o GROUP BY 1, 2, 3),
parts AS (SELECT concat('P', l_partkey) AS p, min(concat('L', l_orderkey, '-', l_linenumber)) AS l FROM lineitem GROUP BY 1),
asked AS (SELECT min(l.ck) AS ck FROM lines l JOIN customer ON c_custkey = l.ck JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey % 2),
apart AS (SELECT l FROM lines WHERE ck IN (SELECT ck FROM asked))
SELECT c AS id, CASE WHEN l IN (SELECT l FROM apart) THEN c ELSE l END AS block FROM lines
UNION ALL SELECT o, l FROM lines UNION ALL SELECT p, CASE WHEN l IN (SELECT l FROM apart) THEN p ELSE l END FROM parts
UNION SELECT l, l FROM lines UNION SELECT l, l FROM parts""")
def G4_online_refine(spark, d):
    """Edges replayed one by one on the ranked hierarchy: every customer with its first order, every such order with its first line,
    every part with its first line; then two customers are found not to be their first orders after all."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    first = o.where("o_orderkey IS NOT NULL").groupBy("o_custkey").agg(F.min(F.struct(F.expr("concat('O', o_orderkey)").alias("o"), "o_orderkey")).alias("of")).select("o_custkey", "of.*")
    lines = first.join(line.select(F.col("l_orderkey").alias("o_orderkey"), "l_orderkey", "l_linenumber"), "o_orderkey").groupBy("o_custkey", "o").agg(F.min(F.expr(LINEITEM_ID)).alias("l"))
    lines = step(lines, "firsts")
    parts = line.groupBy("l_partkey").agg(F.min(F.expr(LINEITEM_ID)).alias("l"))
    named = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    asked = named.groupBy(F.expr("n_regionkey % 2")).agg(F.min("c_custkey").alias("o_custkey")).join(lines, "o_custkey")
    row = lambda df, k, key, u, v, pred: df.selectExpr(f"cast({k} as bigint) * 1000000000000 + {key} as seq", f"{u} as u", f"{v} as v", f"{pred} as pred")
    c = "concat('C', o_custkey)"
    delta = row(lines, 0, "o_custkey", c, "o", 1).unionByName(row(lines, 1, "o_custkey", "o", "l", 1)).unionByName(row(parts, 2, "l_partkey", "concat('P', l_partkey)", "l", 1)).unionByName(row(asked, 3, "o_custkey", c, "o", 0))
    store = incremental.GraphStore(spark, step_path(spark, "graph"))
    store.begin(_edges(spark, d), lambda edges: graph.ranks(None, edges, written=True).withColumn("settled", F.lit(True)))  # the hierarchy has no cycle
    incremental.apply_batch(store, delta, 0, refresh_every=0)
    return store.load().classes


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT DISTINCT parent AS id, 0 AS rank FROM hedges WHERE parent NOT IN (SELECT child FROM hedges)
UNION SELECT e.child, r.rank + 1 FROM r JOIN hedges e ON e.parent = r.id)
SELECT id, CAST(max(rank) AS INTEGER) AS rank FROM r GROUP BY id""")
def W2_inserted_ranks(spark, d):
    """Orders and their edges, then all lines with theirs, come into the ranked upper hierarchy: ranks follow in two batches."""
    top, every = step(_edges(spark, d, False), "edges"), step(_edges(spark, d), "edges")
    known = graph.ranks(None, top, written=True).withColumn("settled", F.lit(True))
    lines = every.where("child LIKE 'L%'")
    for new in (every.where("child LIKE 'O%'"), lines):
        change = levels.insert_edges(step(known, "levels"), top, new)
        known, top = known.join(change.rows, "id", "left_anti").unionByName(change.rows), top.unionByName(new)
    return known.select("id", "rank")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def W2_event_stream(spark, d):
    import uuid

    base = f"{shared_dir(spark)}/lexiloom/stream-{uuid.uuid4().hex}"
    return incremental.event_counts(spark, d, f"{base}/checkpoint", f"{base}/counts")


# ---- agents and prompts


@query("""SELECT p_brand, concat('Examples:', chr(10), string_agg(concat('Source: ', p_name, '; Target: ', p_type, ' -> ', CASE WHEN p_size % 2 = 1 THEN 'Yes' ELSE 'No' END, ' (confidence ', p_size % 11, ')'), chr(10) ORDER BY p_partkey), chr(10)) AS demonstrations FROM part GROUP BY p_brand""")
def M5_demonstrations(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand", "p_partkey", "p_name as source_label", "p_type as target_label", "p_size % 2 as pred_relation", "p_size % 11 as confidence")
    return agents.demonstrations(rows, ["p_brand"], "p_partkey")


M4_SQL = """WITH m AS (SELECT p_partkey, list_filter(list_sort(list_distinct([p_name, p_type])), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '[_0-9]')) AS n, list_filter([p_brand, p_type], lambda t: length(t) >= 2 AND NOT regexp_matches(t, '[_0-9]')) AS p FROM part),
s AS (SELECT p_partkey, CASE WHEN len(n) = 0 THEN 'none' ELSE array_to_string(n, ', ') END AS n, CASE WHEN len(p) = 0 THEN 'none' ELSE array_to_string(p, ', ') END AS p FROM m)
SELECT p_partkey, md5(replace(replace('%s', '<n>', n), '<p>', p)) AS prompt FROM s"""


def _task_text() -> str:
    slots = {"demonstrations": ""} | {f"{x}_names": "<n>" for x in ("src", "tgt")} | {f"{x}_parents": "<p>" for x in ("src", "tgt")} | {f"{x}_{k}": "none" for x in ("src", "tgt") for k in ("children", "synonyms")}
    return agents.TASK.format(**slots).replace("'", "''")


@query(M4_SQL.replace("%s", _task_text()))
def M4_M7_task_prompt(spark, d):
    none = "cast(array() as array<string>)"
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_type", f"named_struct('parents', array(p_brand, p_type), 'children', {none}, 'synonyms', {none}, 'labels', array(p_name)) as meta")
    prompt = agents.task_prompt(F.col("meta"), F.col("meta"), F.col("p_type"), F.col("p_type"))
    return rows.select("p_partkey", F.md5(prompt).alias("prompt"))


@query()
def M3_M6_inference(spark, d):
    """Three rounds of two agents over brand and type names."""
    none = "cast(array() as array<string>)"
    meta = "named_struct('parents', {0}, 'children', {0}, 'synonyms', {0}, 'labels', array({1}))"
    pairs = table(spark, d, "part").selectExpr("p_partkey as pair_id", "p_name as src_code", "p_type as tgt_code", f"{meta.format(none, 'p_name')} as src_meta", f"{meta.format(none, 'p_type')} as tgt_meta", "'' as context")
    out = agents.inference(pairs, agents.create_agents(2, "rules", "rules"), 3, gate=True)
    return out.select("pair_id", "pred", "confidence", "api_metrics.api_calls", "accepted")


@query()
def V7_V8_structural(spark, d):
    """The concepts are regions, nations, customers and suppliers; 200 walks of up to 30 steps from each, 128 numbers."""
    edges = _edges(spark, d, False)
    return embed.structural(graph.nodes_of(None, edges), edges)


@query()
def evaluation_run(spark, d):
    """The whole run on an alignment of part names and types, with dictionary knowledge and the offline stand-ins."""
    part = table(spark, d, "part")
    raw = part.selectExpr("p_name as source", "concat('http://ex.org/a#', p_partkey) as source_uri", "p_type as target", "concat('http://ex.org/b#', p_type) as target_uri", "if(p_size % 2 = 0, '1', '0') as Relation").dropDuplicates(["source", "target"])
    none = "cast(array() as array<string>)"
    words = dictionary.merge(part.selectExpr("p_name as concept_code", "array(p_brand) as parents", f"{none} as children", f"{none} as synonyms", "array(p_name) as labels"))
    settings = evaluation.Settings(options=["envo"], agents=agents.create_agents(2, "rules", "rules"), rounds=2, gate=True)
    return evaluation.records(evaluation.predict(alignments.pairs(raw), knowledge.Sources({"envo": words}), settings))
