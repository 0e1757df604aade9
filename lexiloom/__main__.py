"""Command line: one evaluation run from configuration files.

    python -m lexiloom --method_config method.json --dataset_config dataset.json --csv alignment.csv --out folder
"""

from __future__ import annotations

import argparse
import functools
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.vectors import cosine
from .operators import agents, embed, knowledge, sampling, triples
from .operators.knowledge import Sources
from .plans import evaluation
from .sources import alignments, dictionary, predictions, rdf, remote, sparql
from .storage import exists, share_code, step
from .streaming import incremental

log = logging.getLogger("lexiloom")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexiloom", description="Matches the concepts of two vocabularies and scores the answers.")
    p.add_argument("--method_config", required=True, help="JSON: agent_type, agent_name or agent_configs and n_rounds, task, query_options")
    p.add_argument("--dataset_config", help="JSON: dataset_type, task_name, sample_sz")
    p.add_argument("--csv", required=True, help="the alignment")
    p.add_argument("--dictionary", action="append", default=[], metavar="SOURCE=PATH", help="knowledge of a source, JSON lines")
    p.add_argument("--triples", action="append", default=[], metavar="SOURCE=PATH", help="OWL documents of ncit, doid or dbpedia")
    p.add_argument("--sparql", action="append", default=[], metavar="SOURCE[=URL]", help="an endpoint of ncit, doid or dbpedia to be asked")
    p.add_argument("--ontology", metavar="PATH", help="OWL documents whose class hierarchy is the source 'ontology'")
    p.add_argument("--conceptnet", metavar="URL", help="edges of a concept as JSON, {concept} in the address; with --lexicon")
    p.add_argument("--lexicon", metavar="PATH", help="words that may be asked for, a word a line")
    p.add_argument("--structure", action="store_true", help="structural vectors of the ontology beside those of the text")
    p.add_argument("--graph", type=int, metavar="N", help="refine the concept graph by accepted answers, anew as a whole every N; reviews go beside")
    p.add_argument("--out", required=True, help="folder of predictions and metrics")
    p.add_argument("--llm", help="model in place of the configured one")
    p.add_argument("--size", default="full", choices=list(sampling.SIZES))
    p.add_argument("--baseline", action="store_true")
    p.add_argument("--active_learning", action="store_true", help="gate unsure answers")
    p.add_argument("--debate", action="store_true", help="all configured agents and rounds; else one agent, one round")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("lexiloom").getOrCreate()
    share_code(spark)
    method = dictionary.load_config(a.method_config)
    dataset = dictionary.load_config(a.dataset_config) if a.dataset_config else {}
    task = method.get("task") or dataset.get("task_name", "task")
    own = evaluation.Settings.from_config(method, dataset, size=a.size, gate=a.active_learning)
    if not a.debate:
        own.agents, own.rounds = own.agents[:1], 1
    if a.llm:
        own.agents = [type(x)(model=a.llm) for x in own.agents]
    sources = sources_of(spark, a)
    if a.structure:
        own.structure = {}
    alignment = alignments.load(spark, a.csv, dataset.get("dataset_type", "generic"))
    path = f"{a.out.rstrip('/')}/{predictions.prediction_path(task, own.agents[0].model, a.baseline)}"
    done = predictions.read_predictions(spark, path) if exists(spark, path) and (exists(spark, f"{path}.log") or not exists(spark, f"{path}/batch=0")) else None
    batch = predictions.next_batch(spark, path)
    began = time.time()
    rows = step(evaluation.predict(alignment, sources, own, edges=sources.edges, done=done), "predictions")
    # the graph first: both pass over a batch that they hold, so a run that ends between the two is made up for by the next
    if a.graph:
        refine_graph(spark, rows, f"{path.removesuffix('.jsonl')}.graph", a.graph, batch)
    predictions.append_predictions(evaluation.records(rows), path, batch)
    every = predictions.read_predictions(spark, path)
    row = evaluation.summary(every, method.get("method_name", ""), task, own.options, own.agents[0].model, time.time() - began)
    predictions.write_metrics(row, path)
    log.info("%s", predictions.metrics_json(row))
    return path


def sources_of(spark: SparkSession, a: argparse.Namespace) -> Sources:
    """The knowledge sources that the arguments name."""
    known = {k: dictionary.load_dictionary(spark, path) for k, path in (x.split("=", 1) for x in a.dictionary)}
    terms = {"ncit": triples.ncit_terms, "doid": triples.doid_terms, "dbpedia": triples.dbpedia_terms}
    read = {k: step(rdf.read_owl(spark, path), "triples") for k, path in (x.split("=", 1) for x in a.triples)}
    asked = {k: functools.partial(terms[k], t) for k, t in read.items()}
    for x in a.sparql:
        asked[x.partition("=")[0]] = functools.partial(sparql.fetch, source=sparql.endpoint_of(x)[0], endpoint=sparql.endpoint_of(x)[1])
    edges = step(rdf.hierarchy(rdf.read_owl(spark, a.ontology))[1], "ontology") if a.ontology else None
    net = None
    if a.conceptnet:
        words = spark.read.text(a.lexicon).select(F.lower(F.trim("value")).alias("word"))
        embedder = embed.HashEmbedder()

        def likeness(rows):
            one = embedder.column(F.col("concept"))
            return rows.withColumns({f"sim_{x}": cosine(one, embedder.column(F.col(f"{x}_label"))) for x in ("start", "end")})

        def net(concepts):
            words_only = concepts.join(words.select(F.col("word").alias("concept_code")), "concept_code", "left_semi")
            found = step(remote.fetch_edges(words_only, remote.HttpEdges(a.conceptnet)), "edges")
            return knowledge.edge_terms(concepts, found.where("error IS NULL"), words, likeness)

    return Sources(known, edges, asked, net)


def refine_graph(spark: SparkSession, rows, path: str, every: int, batch: int) -> None:
    """Accepted answers enter the kept concept graph in order of their pairs, ranks following after every few; edges for an expert go to reviews."""
    store = incremental.GraphStore(spark, path)
    taken = rows.where("accepted").select(F.col("pair_id").alias("seq"), F.col("source").alias("u"), F.col("target").alias("v"), F.col("pred_relation").alias("pred"))
    incremental.apply_batch(store, taken, batch, every)
    review_rows(store.expert(batch), f"{path}.reviews", batch)


def review_rows(expert, path: str, batch: int = 0) -> None:
    """The edges that await an expert, as (source, target, u->v)."""
    predictions.append_reviews(expert.select(F.col("u").alias("source"), F.col("v").alias("target"), F.concat("u", F.lit("->"), "v").alias("expert_edge")), path, batch)


__all__ = ["agents", "arguments", "main", "review_rows"]

if __name__ == "__main__":
    main()
