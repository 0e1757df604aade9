"""The evaluation run: alignment to predictions and scores, as one set-oriented plan and a short ordered tail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gate_score
from ..functions.vectors import cosine
from ..operators import agents as ag
from ..operators import embed, graph, knowledge, metrics, refine, sampling, vectors
from ..schemas import PREDICTION
from ..storage import step


@dataclass
class Settings:
    """What a method's and a dataset's configuration say."""

    options: list[str] = field(default_factory=list)
    agents: list[ag.ChatProvider] = field(default_factory=lambda: ag.create_agents(1, "rules", "rules"))
    rounds: int = 1
    sample: int = 1000
    size: str = "full"
    neighbours: int = 3
    shots: int = 5
    gate: bool = False
    epsilon: float = 0.0
    embedder: embed.Embedder = field(default_factory=embed.HashEmbedder)
    structure: dict | None = None  # arguments of embed.structural; None: text vectors alone

    @classmethod
    def from_config(cls, method: dict, dataset: dict | None = None, **more) -> Settings:
        debate = "agent_configs" in method
        own = ag.create_agents_from_config(method["agent_configs"]) if debate else ag.create_agents(1, method["agent_type"], method["agent_name"])
        return cls(options=method.get("query_options", []), agents=own, rounds=method.get("n_rounds", 1) if debate else 1, sample=(dataset or {}).get("sample_sz", 1000), **more)


def sample_pairs(alignment: DataFrame, settings: Settings) -> DataFrame:
    """pair_id, src, tgt, true_relation: as many negatives as positives, made up where the alignment has none."""
    keys = [F.xxhash64(F.lit(42), "src.code", "tgt.code"), F.col("src.code"), F.col("tgt.code"), F.col("src.uri"), F.col("tgt.uri")]
    positive, negative = sampling.split(alignment)
    if negative.isEmpty():
        s, t = (alignment.select(F.col(f"{x}.code").alias(n), F.col(f"{x}.uri").alias(f"{n}_uri")).dropDuplicates([n]) for x, n in (("src", "s"), ("tgt", "t")))
        seen = alignment.select(F.col("src.code").alias("s"), F.col("tgt.code").alias("t")).distinct()
        made = sampling.negatives(s.select("s"), t.select("t"), seen, [F.xxhash64(F.lit(42), "s", "t"), F.col("s"), F.col("t")], settings.sample)
        made = made.join(s, "s").join(t, "t")
        negative = made.select(F.struct(F.col("s").alias("code"), F.col("s_uri").alias("uri")).alias("src"), F.struct(F.col("t").alias("code"), F.col("t_uri").alias("uri")).alias("tgt"), F.lit("0").alias("label"))
    rows = positive.select("src", "tgt", "label").unionByName(negative.select("src", "tgt", "label"))
    rows = sampling.balanced(rows, settings.sample, keys, F.col("label") == "1")
    rows = sampling.fraction(rows, settings.size, keys)
    # numbers from 1 in order; the sample is bounded by twice its size
    rows = rows.withColumn("pair_id", F.row_number().over(Window.orderBy(*keys)).cast("long"))
    return step(rows.select("pair_id", "src", "tgt", F.col("label").cast("int").alias("true_relation")), "pairs")


def predict(alignment: DataFrame, sources: knowledge.Sources, settings: Settings, edges: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Prediction records of the sampled pairs that ``done`` (earlier records) does not hold."""
    pairs = sample_pairs(alignment, settings)
    if done is not None:
        pairs = pairs.join(done.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct(), (F.col("src.code") == F.col("s")) & (F.col("tgt.code") == F.col("t")), "left_anti")
    metadata = step(knowledge.enrich(alignment, settings.options, sources), "metadata")
    both = knowledge.with_metadata(pairs, metadata)
    label = lambda side: F.coalesce(F.try_element_at(f"{side}_meta.labels", F.lit(1)), F.col(f"{side}.code"))
    joined = lambda side: F.array_join(F.when(F.size(f"{side}_meta.labels") > 0, F.col(f"{side}_meta.labels")).otherwise(F.array(f"{side}.code")), ", ")
    both = both.withColumns({f"{x}_label": label(x) for x in ("src", "tgt")} | {f"{x}_vec": settings.embedder.column(joined(x)) for x in ("src", "tgt")})
    both = step(both, "both")
    for side in ("src", "tgt"):
        both = both.join(_near(alignment, metadata, both, side, settings, edges), "pair_id", "left")
    shots = F.lit("")
    if done is not None:
        lines = sampling.demonstrations(done, [F.xxhash64(F.lit(42), "source", "target"), F.col("source"), F.col("target")], settings.shots)
        text = ag.demonstrations(lines.withColumn("one", F.lit(1)).withColumn("o", F.concat_ws("|", "source", "target")), ["one"], "o").select("demonstrations")
        got = text.first()  # five lines at most
        shots = F.lit(got[0] if got else "")
    asked = both.select(
        "pair_id", F.col("src.code").alias("src_code"), F.col("tgt.code").alias("tgt_code"), "src_meta", "tgt_meta",
        ag.context_block(both, F.col("src_near"), F.col("tgt_near"), shots).alias("context"),
    )
    answers = ag.inference(asked, settings.agents, settings.rounds)
    rows = both.join(answers, "pair_id").select(
        "pair_id", F.col("src_label").alias("source_label"), F.col("tgt_label").alias("target_label"), F.col("src.code").alias("source"), F.col("src.uri").alias("source_uri"),
        F.col("tgt.code").alias("target"), F.col("tgt.uri").alias("target_uri"), cosine(F.col("src_vec"), F.col("tgt_vec")).alias("similarity"),
        "confidence", "true_relation", F.col("pred").alias("pred_relation"), "api_metrics",
    )
    if not settings.gate:
        return rows.withColumn("accepted", F.lit(True))
    scored = metrics.running_score(step(rows, "rows"), "pair_id")
    return scored.withColumn("accepted", gate_score(F.col("confidence"), F.col("f1"), epsilon=settings.epsilon) > 0).drop("precision", "recall", "f1")


def _near(alignment: DataFrame, metadata: DataFrame, pairs: DataFrame, side: str, settings: Settings, edges: DataFrame | None) -> DataFrame:
    """pair_id, {side}_near: labels of the nearest concepts of that side that are not under evaluation."""
    pool = alignment.select(F.col(f"{side}.code").alias("id")).distinct().join(pairs.select(F.col(f"{side}.code").alias("id")), "id", "left_anti")
    pool = pool.join(metadata.select(F.col("concept_code").alias("id"), "labels"), "id")
    pool = pool.withColumn("text", F.coalesce(F.try_element_at("labels", F.lit(1)), F.col("id")))
    queries = pairs.select(F.col(f"{side}.code").alias("id"), F.col(f"{side}_label").alias("text")).dropDuplicates(["id"])
    if settings.structure is not None and edges is not None:
        everyone = pool.select("id").unionByName(queries.select("id")).distinct()
        structure = step(embed.structural(everyone, edges, **settings.structure), "structure")
        store = embed.combined(pool.select("id", "text"), structure, settings.embedder)
        asked = embed.combined(queries, structure, settings.embedder)
    else:
        store = pool.select("id", settings.embedder.column(F.col("text")).alias("embedding"))
        asked = queries.select("id", settings.embedder.column(F.col("text")).alias("embedding"))
    hits = vectors.top_k(asked.withColumnRenamed("id", "query_id"), step(store.withColumnRenamed("id", "ext_id"), "store"), settings.neighbours)
    named = hits.join(pool.select(F.col("id").alias("ext_id"), F.array_join("labels", ", ").alias("names")), "ext_id")
    lists = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "names"))), lambda x: x["names"]).alias(f"{side}_near"))
    out = pairs.select("pair_id", F.col(f"{side}.code").alias("query_id")).join(lists, "query_id", "left")
    return out.select("pair_id", F.coalesce(f"{side}_near", F.expr("cast(array() as array<string>)")).alias(f"{side}_near"))


def compress(edges: DataFrame, mode: str = "by_rank") -> tuple[DataFrame, DataFrame]:
    """(blocks, compressed edges) of a concept graph."""
    edges = step(edges.select("parent", "child").distinct(), "edges")
    return refine.offline_refine(edges, graph.ranks(None, edges, written=True), mode, written=True)


def summary(predictions: DataFrame, method: str, task: str, options: list[str], model: str = "rules", seconds: float = 0.0) -> DataFrame:
    """One row: scores, usage and what was run."""
    scores = metrics.score(predictions)
    used = predictions.agg(*[F.coalesce(F.sum(f"api_metrics.{k}"), F.lit(0)).alias(k) for k in ("input_token", "output_token", "api_calls")])
    both = scores.crossJoin(used)
    return both.select(
        F.lit(method).alias("method"), F.lit(task).alias("task"), F.lit(model).alias("agent_model"), F.array(*[F.lit(o) for o in options]).cast("array<string>").alias("query_options"),
        F.struct("input_token", "output_token", "api_calls").alias("api_metrics"), F.struct("precision", "recall", "f1").alias("metrics"), F.lit(seconds).alias("running_time"),
    )


def records(predictions: DataFrame) -> DataFrame:
    return predictions.select(*PREDICTION.fieldNames())
