"""Incremental runs: a file stream of observations, replayed edge by edge on a state of delta files, ranks following the edges.

A state is a folder of tables (edges, levels, labels, links, expert). A batch adds a delta of what it has changed to each, and is
there once its marker row is written; reads merge the deltas up to the last marker, and every ``COMPACT`` versions the
deltas become a base. A batch that failed half way leaves deltas that no marker names, and the next attempt overwrites them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, graph, levels, refine
from ..schemas import DELTA
from ..storage import exists, shared_dir, step

TABLES = {"edges": forest.EDGES, "levels": f"{levels.LEVEL}, seq long", "labels": forest.LABEL, "links": forest.LINK, "expert": "u string, v string, batch long"}
MARK = "version long, batch long, edges_seen long, ranked long, base long, tables string"
COMPACT = 16
#: Edges of a batch from which on they are met with the graph's by a shuffle and hash tables.
MANY = 1 << 17


class GraphStore:
    """A state kept as tables of a base and deltas under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/graph").rstrip("/")

    def _marks(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/versions"):
            return self.spark.createDataFrame([], MARK)
        return self.spark.read.schema(MARK).json(f"{self.path}/versions")

    def mark(self):
        """The last version's marker, or None."""
        return self._marks().orderBy(F.desc("version")).first()

    def last(self) -> tuple[int, int, int]:
        """(version, batch, edges seen); version -1 before the first."""
        got = self.mark()
        return (got.version, got.batch, got.edges_seen) if got else (-1, -1, 0)

    def _parts(self, table: str) -> tuple[DataFrame | None, DataFrame | None]:
        """The base of a table, and its deltas, where there are any."""
        got = self.mark()
        if not got:
            return None, None
        read = self.spark.read.schema(TABLES[table])
        after = self._marks().where((F.col("version") > got.base) & F.array_contains(F.split("tables", ","), table)).select("version").collect()  # COMPACT rows at most
        paths = [f"{self.path}/{table}/delta-{r.version}" for r in sorted(after)]
        return read.parquet(f"{self.path}/{table}/base-{got.base}") if got.base >= 0 else None, read.parquet(*paths) if paths else None

    def table(self, name: str) -> DataFrame:
        base, deltas = self._parts(name)
        if name != "levels" or deltas is None:
            parts = [x for x in (base, deltas) if x is not None]
            return forest.union(parts) if parts else self.spark.createDataFrame([], TABLES[name])
        last = deltas.groupBy("id").agg(F.max(F.struct("seq", "rank", "settled")).alias("at")).select("id", "at.rank", "at.settled", "at.seq")
        return last if base is None else base.join(deltas.select("id"), "id", "left_anti").unionByName(last)

    def load(self) -> refine.State:
        """The state as a whole, classes resolved."""
        ranks = self.table("levels").where("rank IS NOT NULL").select("id", "rank")
        return refine.State(self.table("edges").select("parent", "child"), ranks, forest.classes(self.table("labels"), self.table("links")), self.table("expert").select("u", "v"))

    def expert(self, batch: int) -> DataFrame:
        """The edges (u, v) of a batch that await an expert."""
        return self.table("expert").where(F.col("batch") == batch).select("u", "v")

    def begin(self, edges: DataFrame, known: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> None:
        """The first version, a base: distinct edges, written once, and their levels: a table, or what ``known`` makes of the edges as written."""
        zero = F.lit(0).cast("long").alias("seq")
        version = self.last()[0] + 1
        path = f"{self.path}/edges/base-{version}"
        edges.select("parent", "child", zero).write.mode("overwrite").parquet(path)
        edges = self.spark.read.schema(TABLES["edges"]).parquet(path).select("parent", "child")
        if not isinstance(known, DataFrame):
            known = (known or (lambda e: levels.levels(None, e)))(edges)
        known.select("id", "rank", "settled", zero).write.mode("overwrite").parquet(f"{self.path}/levels/base-{version}")
        none = {k: self.spark.createDataFrame([], TABLES[k]) for k in ("labels", "links", "expert")}
        self._commit(none, -1, 0, 0, base=version)

    def commit(self, added: dict[str, list[DataFrame]], batch: int, seen: int, ranked: int) -> None:
        """A new version: tables of rows to add; edges that the graph has are left out."""
        new = {k: forest.union(v) for k, v in added.items() if v}
        if "expert" in new:
            new["expert"] = new["expert"].withColumn("batch", F.lit(batch).cast("long"))
        if "edges" in new:
            edges = step(new["edges"].groupBy("parent", "child").agg(F.min("seq").alias("seq")), "edges")
            asked = edges.select("parent", "child")
            if edges.count() > MANY:  # still few beside the graph's, which need not be sorted
                asked = asked.hint("shuffle_hash")
            known = self.table("edges").join(asked, ["parent", "child"], "left_semi").select("parent", "child")
            new["edges"] = edges.join(known, ["parent", "child"], "left_anti")
        self._commit(new, batch, seen, ranked)
        got = self.mark()
        if got.version - got.base >= COMPACT:
            self.compact()

    def _commit(self, tables: dict[str, DataFrame], batch: int, seen: int, ranked: int, base: int | None = None) -> None:
        got = self.mark()
        version = got.version + 1 if got else 0
        kind = "delta" if base is None else "base"
        for k, rows in tables.items():
            # columns in the order of the schema; rows near in key lie near
            rows.select(*[F.col(c.split()[0]) for c in TABLES[k].split(", ")]).sortWithinPartitions(TABLES[k].split()[0]).write.mode("overwrite").parquet(f"{self.path}/{k}/{kind}-{version}")
        keep = got.base if got else -1
        row = (version, batch, seen, ranked, version if base is not None else keep, ",".join(tables))
        self.spark.createDataFrame([row], MARK).coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def compact(self) -> None:
        """All tables as a base: one label a node, no links."""
        got = self.mark()
        found = forest.resolve(None, self.table("labels"), self.table("links"))
        tables = {k: self.table(k) for k in ("edges", "levels", "expert")}
        tables["labels"] = found.select("id", "name", F.lit(2 * got.edges_seen).cast("long").alias("seq"))
        tables["links"] = self.spark.createDataFrame([], forest.LINK)
        self._commit(tables, got.batch, got.edges_seen, got.ranked, base=got.version + 1)


def apply_batch(store: GraphStore, rows: DataFrame, batch: int, refresh_every: int = 5, keep_rejected: bool = False) -> None:
    """The batch's edges (seq, u, v, pred) in order, one by one. A batch that was stored before is passed over.

    After every ``refresh_every`` edges (0: never, and the batch is replayed as a table) the ranks follow the edges that came since.
    """
    got = store.mark()
    if got and batch <= got.batch:
        return
    ranked, known = (got.ranked if got else 0), store.table("levels")
    replay = forest.Replay(store.table("edges"), known, store.table("labels"), store.table("links"), got.edges_seen if got else 0, keep_rejected)
    changes: list[DataFrame] = []
    if not refresh_every:
        replay.run_table(rows)
    edges = forest.in_order(rows) if refresh_every else iter(())
    while part := list(islice(edges, refresh_every - replay.seen % refresh_every if refresh_every else forest.ROUND)):
        replay.run(part)
        if replay.seen % refresh_every == 0:
            every = replay.after("edges")
            change = levels.insert_edges(known.select("id", "rank", "settled"), every.where(F.col("seq") <= ranked), every.where(F.col("seq") > ranked))
            ranked = replay.seen
            changed = change.rows.select("id", "rank", "settled", F.lit(ranked).cast("long").alias("seq"))
            changes.append(changed)
            known = known.join(changed.select("id"), "id", "left_anti").unionByName(changed)
            if len(changes) % 8 == 0:
                known = step(known, "levels")
            replay.ranks = known.select("id", "rank")
    store.commit({**replay.new, "levels": changes}, batch, replay.seen, ranked)


def recompress(state: refine.State) -> refine.State:
    """Ranks of the whole graph, and classes by offline refinement; nodes without rank keep their class."""
    nodes = graph.nodes_of(state.classes, state.edges)
    ranks = step(graph.ranks(nodes, state.edges), "ranks")
    blocks, _ = refine.offline_refine(state.edges, ranks)
    rest = state.classes.join(blocks.select("id"), "id", "left_anti")
    return refine.State(state.edges, ranks, step(blocks.unionByName(rest), "classes"), state.expert)


def run_stream(spark: SparkSession, source: str, store: GraphStore, checkpoint: str, refresh_every: int = 5, pattern: str = "*.json") -> None:
    """All delta files at ``source``, then stops; the next call goes on where this one ended."""
    stream = spark.readStream.schema(DELTA).option("pathGlobFilter", pattern).json(source)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: apply_batch(store, rows, batch, refresh_every))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def event_counts(spark: SparkSession, sf_dir: str, checkpoint: str, path: str) -> DataFrame:
    """The events table read as a file stream into batch-keyed partial counts; replays of a batch overwrite it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def write(rows: DataFrame, batch: int) -> None:
        rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(path)
    return parts.groupBy("event_type").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("total"), 4).alias("total"))
