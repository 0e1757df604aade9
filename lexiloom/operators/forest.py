"""Classes of a concept graph as a forest in time, and the replay of single edges on it.

A node's label (id, name, seq) says which class it entered at that time; a link (name, into, seq) says that all who were in
class ``name`` then went over to ``into``. A node is in the class that its last label leads to along later links, so two
classes join by one row, whatever their size, and a name can be used again. Times are twice the number of an edge for new
nodes and one more for what the edge does.

Edges are replayed in order. Joining by rank needs the classes of the edge's ends only; a round of edges asks for those of all its
ends at once. Equal ranks and rejected matches move members one by one: these are found by joins over the members and
edges at hand, and one label is written for each that moves.

A table of edges (``run_table``) is replayed in windows: classes that no edge of the window connects do not know of one another, so
tasks replay one component at a time, each up to the first edge that moves members. What comes before the first of these
edges in the whole window holds; from there on a round of single edges follows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import share_code, step, step_path
from . import graph

LABEL, LINK, EDGES = "id string, name string, seq long", "name string, into string, seq long", "parent string, child string, seq long"
#: Edges whose ends are looked up together; the driver holds two classes an edge.
ROUND = 2000
#: Most edges of a window: one component of them, and so what one task holds, is no larger.
WINDOW = 1 << 21
NEVER = -1


def resolve(ids: DataFrame | None, labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, name: the classes of ``ids``, or of all labelled nodes. Nodes without label are their own class.

    A round writes the ids that it is about, each once; those that have found a later link go on to the next.
    """
    spark, base, rounds = labels.sparkSession, step_path(labels.sparkSession, "classes"), 0
    last = (labels if ids is None else labels.join(ids, "id", "left_semi")).groupBy("id").agg(F.max(F.struct("seq", "name")).alias("at"))
    at = last.select("id", "at.name", "at.seq")
    if ids is not None:
        at = ids.select("id").join(at, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("seq", F.lit(NEVER).cast("long")).alias("seq"))
    later = links.select(F.col("name").alias("left"), "into", F.col("seq").alias("then"))
    shape = "id string, name string, seq long, moved boolean"
    while True:
        to = F.min(F.when(F.col("then").isNotNull(), F.struct("then", "into"))).alias("to")
        met = at.join(later, (F.col("name") == F.col("left")) & (F.col("then") > F.col("seq")), "left").groupBy("id", "name", "seq").agg(to)
        seen = Observation()
        now = met.select("id", F.coalesce("to.into", "name").alias("name"), F.coalesce("to.then", "seq").alias("seq"), F.col("to").isNotNull().alias("moved"))
        now.observe(seen, F.count_if("moved").alias("moved")).write.parquet(f"{base}/round={rounds}")
        if not seen.get["moved"]:
            return spark.read.schema(f"{shape}, round int").parquet(base).where("NOT moved").select("id", "name")
        at = spark.read.schema(shape).parquet(f"{base}/round={rounds}").where("moved").drop("moved")
        rounds += 1


def members(names: list[str], labels: DataFrame, links: DataFrame) -> DataFrame:
    """block, id: the labelled nodes of each class; spans of time of all names that lead to it, then the last labels in them."""
    spark = labels.sparkSession
    start = spark.createDataFrame([(x,) for x in names], "name string").coalesce(1)
    none = F.lit(NEVER - 1).cast("long")  # before the first labels
    gone = links.join(F.broadcast(start), "name", "left_semi").groupBy("name").agg(F.max("seq").alias("lo"))
    spans = front = step(start.join(gone, "name", "left").select(F.col("name").alias("block"), "name", F.coalesce("lo", none).alias("lo"), F.lit(2**62).alias("hi")), "spans")
    while True:
        came = links.join(front.select("block", F.col("name").alias("into"), "lo", "hi"), "into").where("seq > lo AND seq <= hi").select("block", "name", F.col("seq").alias("hi"))
        earlier = links.select("name", F.col("seq").alias("then"))
        front = came.join(earlier, "name").where("then <= hi").groupBy("block", "name", "hi").agg(F.max(F.when(F.col("then") < F.col("hi"), F.col("then"))).alias("lo"))
        front = step(front.select("block", "name", F.coalesce("lo", none).alias("lo"), "hi"), "spans")
        if front.isEmpty():
            break
        spans = spans.unionByName(front)
    held = step(labels.join(spans, "name").where("seq > lo AND seq <= hi").select("block", "id", "seq"), "held")
    last = labels.join(held.select("id"), "id", "left_semi").groupBy("id").agg(F.max("seq").alias("seq"))
    return step(held.join(last, ["id", "seq"], "left_semi").select("block", "id").distinct(), "members")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Replay:
    """The state that edges are replayed on, and what they have added: edges (parent, child, number of the edge), labels, links, expert (u, v)."""

    def __init__(self, edges: DataFrame, ranks: DataFrame, labels: DataFrame, links: DataFrame, seen: int = 0, keep_rejected: bool = False) -> None:
        self.spark: SparkSession = edges.sparkSession
        self.edges = edges if "seq" in edges.columns else edges.select("parent", "child", F.lit(0).cast("long").alias("seq"))
        self.ranks, self.labels, self.links = ranks.select("id", "rank"), labels, links
        self.seen, self.keep_rejected = seen, keep_rejected
        self.new: dict[str, list[DataFrame]] = {"edges": [], "labels": [], "links": [], "expert": []}
        self.barriers = 0
        self.near: DataFrame | None = None  # of the ranks, those that the table at hand can ask for

    def run(self, rows: Iterable[tuple[str, str, int]]) -> None:
        """Edges (u, v, prediction) in order."""
        rows = iter(rows)
        while part := list(islice(rows, ROUND)):
            self._round(part)

    def run_table(self, rows: DataFrame) -> None:
        """Edges (seq, u, v, pred) in the order of all columns, as a table."""
        rows = step(_in_places(rows), "rows")
        end, at, size = rows.count(), 0, WINDOW
        while at < end:
            part = rows.where((F.col("no") >= at) & (F.col("no") < at + size))
            barriers = self.barriers
            if size <= ROUND or end - at <= ROUND:
                part = part.where(F.col("no") < at + ROUND).orderBy("no").collect()  # ROUND rows at most
                self._round([(r.u, r.v, r.pred) for r in part])
                if self.barriers > barriers:
                    self.near = None  # members have moved, perhaps to names that were none
                at, size = at + len(part), ROUND if self.barriers > barriers else max(size, 16 * ROUND)
            else:
                if self.near is None:
                    self.near = self._near(rows.where(F.col("no") >= at))
                to = self._window(part, at, min(end, at + size))
                size = min(WINDOW, 16 * size) if to == min(end, at + size) else ROUND
                at = to
        self.near = None

    def _near(self, rows: DataFrame) -> DataFrame:
        """The ranks of all names that classes of the rows' ends can have until members move: looked up once, not by every window."""
        ends = rows.select(F.explode(F.array("u", "v")).alias("id"))
        names = union([ends, self.after("labels").select(F.col("name").alias("id")), self.after("links").select(F.col("into").alias("id"))])
        return step(self.ranks.join(names.distinct(), "id", "left_semi"), "near")

    def _window(self, part: DataFrame, at: int, to: int) -> int:
        """The edges (no, u, v, pred) from ``at`` on up to the first that moves members, or to ``to``; returns where that is."""
        first = self.seen - at  # an edge's number among all is its place and this
        both = part.select("no", F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.min("no").alias("since"))
        both = step(both, "ends")
        labels = self.after("labels")
        held = step(both.join(labels, "id", "left_semi").select("id"), "held")
        classes = resolve(held, labels, self.after("links")) if not held.isEmpty() else held.withColumn("name", F.col("id"))
        named = both.join(classes, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.col("name").isNull().alias("fresh"), "since")
        # only where others are in a class of a new node's name does it matter when that node comes
        used = classes.select("name").distinct().withColumn("used", F.lit(True))
        named = named.join(self.near.select(F.col("id").alias("name"), "rank"), "name", "left").join(used, "name", "left")
        late = F.col("fresh") & F.coalesce("used", F.lit(False))
        named = step(named.select("id", "name", "fresh", late.alias("late"), "since", F.coalesce("rank", F.lit(0)).cast("int").alias("rank")), "named")
        end = lambda x: named.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("name", "late", "rank")])
        edges = step(part.join(end("u"), "u").join(end("v"), "v"), "window")
        found = graph.components(edges.where("pred = 1 OR u_name = v_name").select(F.col("u_name").alias("a"), F.col("v_name").alias("b")))
        found = step(found, "components")
        of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"{x}_of"))
        linked = F.coalesce(F.expr("pred = 1 OR u_name = v_name"), F.lit(False))  # such ends are in one component
        others = edges.where(~linked).join(of("u_name"), "u_name").join(of("v_name"), "v_name").where("u_name_of = v_name_of").drop("v_name_of")
        rows = edges.where(linked).join(of("u_name"), "u_name").unionByName(others)
        rows = rows.select(F.col("u_name_of").alias("component"), "no", F.lit(1).alias("kind"), *[f"{x}{c}" for x in "uv" for c in ("", "_name", "_late", "_rank")], "pred")
        born = named.where("late").join(found.select(F.col("id").alias("name"), "component"), "name")
        none = F.lit(None)
        born = born.select(
            "component", F.col("since").alias("no"), F.lit(0).alias("kind"), F.col("id").alias("u"), F.col("name").alias("u_name"), F.col("late").alias("u_late"), F.col("rank").alias("u_rank"),
            none.cast("string").alias("v"), none.cast("string").alias("v_name"), none.cast("boolean").alias("v_late"), none.cast("int").alias("v_rank"), none.cast("int").alias("pred"),
        )
        share_code(self.spark)
        dealt = rows.unionByName(born).repartition("component").sortWithinPartitions("component", "no", "kind", "u")
        links = step(dealt.mapInArrow(_replayed, "name string, into string, no long"), "links")
        barrier = links.where("into IS NULL").agg(F.min("no").alias("no")).first()["no"]
        to = to if barrier is None else barrier
        added = {
            "edges": part.where(F.lit(self.keep_rejected) | (F.col("pred") == 1)).select("no", "u", "v", (F.col("no") + first + 1).alias("seq")).select(F.col("u").alias("parent"), F.col("v").alias("child"), "seq", "no"),
            "labels": named.where("fresh").select("id", F.col("id").alias("name"), (2 * (F.col("since") + first)).alias("seq"), F.col("since").alias("no")),
            "links": links.where("into IS NOT NULL").select("name", "into", (2 * (F.col("no") + first) + 1).alias("seq"), "no"),
        }
        for table, more in added.items():
            self.new[table].append(step(more.where(F.col("no") < to).drop("no"), table))
        self.seen += to - at
        return to

    def after(self, table: str) -> DataFrame:
        """A table as it is with what has been added."""
        return union([getattr(self, table), *self.new[table]])

    def _add(self, table: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.new[table].append(step(self.spark.createDataFrame(rows, schema).coalesce(1), table))
            rows.clear()
            if len(self.new[table]) > 8:
                self.new[table] = [step(union(self.new[table]), table)]

    def _round(self, rows: list[tuple[str, str, int]]) -> None:
        names = {x for u, v, _ in rows for x in (u, v)}
        ends = step(self.spark.createDataFrame([(x,) for x in names], "id string").coalesce(1), "ends")
        labels = self.after("labels")
        fresh = names - {r.id for r in labels.join(F.broadcast(ends), "id", "left_semi").select("id").distinct().collect()}
        at = {r.id: r.name for r in resolve(ends, labels, self.after("links")).collect() if r.id not in fresh}
        ids = self.spark.createDataFrame([(x,) for x in {*names, *at.values()}], "id string").coalesce(1)
        ranks = self.ranks if self.near is None else self.near
        rank = {r.id: r.rank for r in ranks.join(F.broadcast(ids), "id", "left_semi").collect()}  # four names an edge at most
        by: dict[str, set[str]] = defaultdict(set)
        for node, name in at.items():
            by[name].add(node)
        links: list[tuple[str, str, int]] = []
        edges: list[tuple[str, str, int]] = []
        born: list[tuple[str, str, int]] = []
        asked: list[tuple[str, str]] = []

        def flush() -> None:
            self._add("edges", edges, EDGES)
            self._add("labels", born, LABEL)
            self._add("links", links, LINK)

        for u, v, pred in rows:
            now, self.seen = 2 * self.seen + 1, self.seen + 1
            for x in (u, v):
                if x in fresh:
                    fresh.discard(x)
                    at[x] = x
                    by[x].add(x)
                    born.append((x, x, now - 1))
            if pred == 1 or self.keep_rejected:
                edges.append((u, v, self.seen))
            bu, bv = at[u], at[v]
            ru, rv = rank.get(bu) or 0, rank.get(bv) or 0
            if pred == 1 and bu != bv and ru != rv:
                winner, loser = (bu, bv) if ru > rv else (bv, bu)
                links.append((loser, winner, now))
                for x in by[loser]:
                    at[x] = winner
                by[winner] |= by.pop(loser)
            elif (pred == 1 and bu != bv) or (pred == 0 and bu == bv):
                flush()
                self.barriers += 1
                moved = step((self._partly(bu, bv) if pred == 1 else self._apart(bu, v)).withColumn("seq", F.lit(now).cast("long")), "labels")
                self.new["labels"].append(moved)
                if pred == 0:
                    asked.append((u, v))
                for r in moved.join(ends, "id", "left_semi").collect():
                    fresh.discard(r.id)
                    by[at.get(r.id, r.id)].discard(r.id)
                    at[r.id] = r.name
                    by[r.name].add(r.id)
        flush()
        self._add("expert", asked, "u string, v string")

    def _members(self, *blocks: str) -> DataFrame:
        """block, id of labelled members; a class without any is its own node."""
        found = members(list(blocks), self.after("labels"), self.after("links"))
        own = self.spark.createDataFrame([(x, x) for x in blocks], "block string, id string").coalesce(1)
        # written, so that few members are known to be few
        return step(found.unionByName(own.join(found.select("block"), "block", "left_anti")), "members")

    def _touching(self, above: DataFrame, below: DataFrame) -> DataFrame:
        """parent, child, down, up: the edges whose parent is among ``above`` (down) or whose child among ``below`` (up), read once."""
        at = lambda ids, end, mark: ids.select(F.col("id").alias(end), F.lit(True).alias(mark))
        met = self.after("edges").select("parent", "child").join(at(above, "parent", "down"), "parent", "left").join(at(below, "child", "up"), "child", "left")
        return met.where("down OR up")

    def _partly(self, bu: str, bv: str) -> DataFrame:
        """Parents of v's class join u's class, children of u's class then v's."""
        held = self._members(bu, bv)
        met = self._touching(held.where(F.col("block") == bu), held.where(F.col("block") == bv))
        moves = [F.when(F.col("up"), F.struct(F.col("parent").alias("id"), F.lit(0).alias("last"))), F.when(F.col("down"), F.struct(F.col("child").alias("id"), F.lit(1).alias("last")))]
        moved = met.select(F.explode(F.array_compact(F.array(*moves))).alias("to")).select("to.id", "to.last").groupBy("id").agg(F.max("last").alias("last"))
        return moved.select("id", F.when(F.col("last") == 1, bv).otherwise(bu).alias("name"))

    def _apart(self, block: str, v: str) -> DataFrame:
        """Members whose children or parents are not v's, a member too: the numbers of all, of v's and of common ones differ."""
        held = self._members(block).select("id")
        met = step(self._touching(held, held), "touching")
        out = held
        for one, other, mark in (("parent", "child", "down"), ("child", "parent", "up")):
            near = met.where(mark).select(F.col(one).alias("id"), F.col(other).alias("x")).distinct()
            own = near.where(F.col("id") == v).select("x")
            common = near.join(own.withColumn("own", F.lit(1)), "x", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("own").alias("c"))
            same = F.coalesce(F.col("n"), F.lit(0)) == F.lit(own.count())
            out = out.join(common, "id", "left").withColumn(f"same_{one}", same & (F.coalesce(F.col("n"), F.lit(0)) == F.coalesce(F.col("c"), F.lit(0)))).drop("n", "c")
        return out.where("NOT (same_parent AND same_child)").select("id", F.col("id").alias("name"))


def _in_places(rows: DataFrame) -> DataFrame:
    """no (from 0, in the order of all columns), u, v, pred: places within a sorted range behind the ranges before it."""
    kept = rows.select(F.col("seq").cast("long"), "u", "v", F.col("pred").cast("int").alias("pred")).orderBy("seq", "u", "v", "pred")
    at = step(kept.select("u", "v", "pred", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("place")), "ordered")
    counts = at.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), "range").select((F.col("place") + F.col("before")).alias("no"), "u", "v", "pred")


class _Component:
    """The classes that a component's edges join, by name: what was in a class goes over as a whole."""

    def __init__(self) -> None:
        self.up: dict[tuple, tuple] = {}
        self.name: dict[tuple, str] = {}  # of a root
        self.live: dict[str, tuple] = {}  # the root of the class of that name
        self.rank: dict[str, int] = {}

    def find(self, x: tuple) -> tuple:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def known(self, name: str, rank: int) -> tuple:
        """Those who are in a class since before the window."""
        x = (0, name)
        if x not in self.up:
            self.up[x], self.name[x], self.live[name], self.rank[name] = x, name, x, rank
        return x

    def born(self, node: str, rank: int) -> None:
        self.known(node, rank)
        x = (1, node)
        self.up[x] = x
        if node in self.live:
            self.up[x] = self.live[node]
        else:
            self.name[x], self.live[node] = node, x

    def edge(self, u: tuple, v: tuple, pred: int) -> tuple[str, str | None] | None:
        """(loser, winner), or (name, None) where members move, or nothing."""
        a, b = self.find(u), self.find(v)
        if pred != 1:
            return (self.name[a], None) if a == b and pred == 0 else None
        if a == b:
            return None
        one, two = self.name[a], self.name[b]
        if self.rank[one] == self.rank[two]:
            return one, None
        if self.rank[one] < self.rank[two]:
            a, b, one, two = b, a, two, one
        self.up[b] = a
        del self.name[b], self.live[two]
        return two, one


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (name, into, no) of rows sorted by component, no, kind (0: a node is born into a class that others are in, 1: an edge); into is null where a component ends."""
    at, now, over = None, _Component(), False
    for batch in batches:
        out = []
        for component, no, kind, u, u_name, u_late, u_rank, v, v_name, v_late, v_rank, pred in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if component != at:
                at, now, over = component, _Component(), False
            if over:
                continue
            if not kind:
                now.born(u, u_rank)
                continue
            ends = [(1, x) if late else now.known(name, rank) for x, name, late, rank in ((u, u_name, u_late, u_rank), (v, v_name, v_late, v_rank))]
            got = now.edge(*ends, pred)
            if got:
                out.append((*got, no))
                over = got[1] is None
        names, into, numbers = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(into, pa.string()), pa.array(numbers, pa.int64())], names=["name", "into", "no"])


def classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, block of all labelled nodes."""
    return resolve(None, labels, links).select("id", F.col("name").alias("block"))


def in_order(rows: DataFrame) -> Iterator[tuple[str, str, int]]:
    """Edges (seq, u, v, pred) by seq, a partition at a time."""
    return ((r.u, r.v, r.pred) for r in rows.select("seq", "u", "v", "pred").orderBy("seq", "u", "v", "pred").toLocalIterator())
