"""Earlier predictions, for resuming, and the sinks of a run.

A sink is a folder with a part for every batch, and a log beside it that names the batches written in full. A batch that is
written again replaces its part, and readers see the parts that the log names only: a batch counts once, however often it
was tried, and one that failed half way not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PREDICTION
from ..storage import exists


def prediction_path(task: str, agent: str, baseline: bool = False) -> str:
    return f"results/{'baseline' if baseline else 'results'}/{task}/{agent.replace('/', '-')}_{task}.jsonl"


def commits(spark: SparkSession, path: str) -> list[int]:
    """The batches that the sink holds, in order."""
    if not exists(spark, f"{path}.log"):
        return []
    return sorted(r.batch for r in spark.read.schema("batch long").json(f"{path}.log").distinct().collect())


def next_batch(spark: SparkSession, path: str) -> int:
    """The number that a run's new predictions have until they are committed."""
    return max(commits(spark, path), default=-1) + 1


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The records of a sink's batches, or of a JSON lines file; see ``first_records``."""
    if exists(spark, f"{path}.log"):
        paths = [f"{path}/batch={b}" for b in commits(spark, path)]
    else:
        paths = [path]
    return first_records(spark.read.text(paths).select(F.monotonically_increasing_id().alias("line"), "value"))


def first_records(lines: DataFrame) -> DataFrame:
    """Of lines (line, value) the first record of every (source, target); blank and malformed lines are passed over."""
    rows = lines.where(F.trim("value") != "").select("line", F.from_json("value", PREDICTION).alias("r")).select("line", "r.*")
    rows = rows.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy("line"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth", "line")


def append_predictions(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Writes a batch (the next one where no number is given) and commits it; one that is committed is left as it is."""
    spark = rows.sparkSession
    held = commits(spark, path)
    batch = next_batch(spark, path) if batch is None else batch
    if batch in held:
        return
    rows.select(*PREDICTION.fieldNames()).write.mode("overwrite").json(f"{path}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").json(f"{path}.log")


def append_reviews(rows: DataFrame, path: str, batch: int = 0) -> None:
    """source, target, expert_edge as quoted CSV with a header in every part; a batch that is written again replaces its part."""
    rows.select("source", "target", "expert_edge").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/batch={batch}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one row of metrics as JSON, beside the predictions."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path.removesuffix('.jsonl')}.metrics.json")


def metrics_json(metrics: DataFrame) -> dict:
    return json.loads(metrics.toJSON().first())
