"""Concept graphs as nodes (id) and edges (parent, child): union, degrees, longest-path ranks, closure, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import step, step_path


def merge_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of nodes and of edges; ends of edges are nodes."""
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes_of(nodes, edges), edges.distinct()


def nodes_of(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("parent").alias("id")).unionByName(edges.select(F.col("child").alias("id")))
    return (ends if nodes is None else nodes.select("id").unionByName(ends)).distinct()


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree: incoming edges, 0 for roots."""
    counts = edges.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def ranks(nodes: DataFrame | None, edges: DataFrame, written: bool = False) -> DataFrame:
    """id, rank: the longest path from a root. Ends of edges are nodes, with or without ``nodes``.
    ``written``: the edges are a table of distinct rows, which need not be written once more.

    A node of one parent lies one below it, so chains and trees are contracted first: every such node learns its nearest
    ancestor of another kind (a root, or a node of several parents), and how far it is, by doubling its pointer. Below a root that
    is its rank, so no edge from a root is joined by its name, which may have most of the graph below it. What is left are
    nodes of several parents with weighted edges from such nodes; they are peeled a level a step, each once its last
    parent has been, with the greatest sum of rank and weight. Steps: the logarithm of the longest chain, and the longest
    path in nodes of several parents. Nodes on a cycle are never peeled: those of several parents get the greatest rank of
    a peeled parent plus one, if there is one, others none.
    """
    spark = edges.sparkSession
    every = edges.select("parent", "child") if written else step(edges.select("parent", "child").distinct(), "edges")
    # dealt by child first: names are aggregated in their order, so rows are sorted once
    into = step(every.repartition("child").groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up")), "parents")
    # what has children, with the number of its parents: mostly far less than all nodes
    above = step(every.select(F.col("parent").alias("id")).distinct().join(into.select("id", "n"), "id", "left"), "above")
    roots = above.where("n IS NULL").select("id")
    if nodes is not None:
        roots = roots.unionByName(nodes.select("id").distinct().join(into.select("id"), "id", "left_anti")).distinct()
    near, _ = _pointers(into, above)
    # a parent that leads into a cycle keeps its own name, which is never peeled; one below a root has its rank already
    led = above.where("n IS NOT NULL").select("id").join(near.select("id", F.col("up").alias("to"), "far", "root"), "id", "left")
    led = led.select(F.col("id").alias("parent"), F.when(~F.coalesce("root", F.lit(False)), F.coalesce("to", "id")).alias("to"), F.coalesce("far", F.lit(0)).alias("far"))
    # dealt by child once: the sums below need no further shuffle
    met = every.join(led, "parent", "left").select("child", "to", (F.coalesce("far", F.lit(0)) + 1).alias("weight")).repartition("child")
    met = met.groupBy("child", "to").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("edges"))
    contracted = step(met, "contracted")
    left = contracted.where("to IS NOT NULL").select(F.col("to").alias("parent"), "child", "weight")
    base = f"{step_path(spark, 'levels')}"
    shape = "id string, open long, rank int, met long"

    def write(counts: DataFrame, level: int) -> tuple[int, int]:
        """How many nodes are peeled at the level, and how many edges it met."""
        seen = Observation()
        counts.observe(seen, F.count_if(F.col("open") == 0).alias("peeled"), F.coalesce(F.sum("met"), F.lit(0)).alias("met")).write.parquet(f"{base}/level={level}")
        return seen.get["peeled"], seen.get["met"]

    zero = F.lit(0).cast("long")
    counts = contracted.groupBy(F.col("child").alias("id")).agg(
        F.sum("edges").alias("n"), F.count("to").alias("open"), F.max(F.when(F.col("to").isNull(), F.col("weight"))).cast("int").alias("rank")
    )
    counts = counts.where("n > 1").select("id", "open", "rank", zero.alias("met"))
    peeled, _ = write(counts, 0)
    # what is left: edges into nodes of several parents from others of them
    inner = spark.read.schema(shape).parquet(f"{base}/level=0").where("open > 0").select(F.col("id").alias("child"))
    left = step(left.join(inner, "child", "left_semi"), "contracted")
    level, behind, size = 0, 0, left.count()
    while peeled and size:
        now = spark.read.schema(shape).parquet(f"{base}/level={level}")
        if 2 * behind > size:  # edges are rewritten once half of them are behind
            left = step(left.join(now.where("open > 0").select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child", "weight"), "contracted")
            behind, size = 0, left.count()
        front = now.where("open = 0").select(F.col("id").alias("parent"), F.col("rank").alias("top"))
        met = left.join(front, "parent").groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("now"), F.max(F.col("top") + F.col("weight")).cast("int").alias("by"))
        counts = now.where("open > 0").join(met, "id", "left").withColumn("now", F.coalesce("now", zero))
        level += 1
        peeled, met_now = write(counts.select("id", (F.col("open") - F.col("now")).alias("open"), F.greatest("rank", "by").alias("rank"), F.col("now").alias("met")), level)
        behind += met_now
    found = spark.read.schema(f"{shape}, level int").parquet(base)
    known = found.where("open = 0").select("id", "rank")
    fed = found.where((F.col("level") == level) & (F.col("open") > 0) & F.col("rank").isNotNull()).select("id", "rank")
    below = near.where("root").select("id", F.col("far").alias("rank")).unionByName(
        near.where("NOT root").join(known.withColumnRenamed("id", "up"), "up").select("id", (F.col("rank") + F.col("far")).cast("int").alias("rank"))
    )
    return roots.select("id", F.lit(0).alias("rank")).unionByName(known).unionByName(fed).unionByName(below)


def _pointers(into: DataFrame, above: DataFrame) -> tuple[DataFrame, int]:
    """into: id, n (its parents), up (its one parent), above: id, n of all that have children (n null: no parent) -> id, up, far, root of the ids of one parent: up is not such an id, far
    the distance to it, root whether it has no parent; ids that lead into a cycle are left out.

    In a round every pointer takes over the pointer it points to, so chains of twice the length end in each; a round that ends
    none while some are open leaves cycles only.
    """
    spark = into.sparkSession
    base, rounds = step_path(spark, "pointers"), 0
    schema = "id string, up string, far int, root boolean, done boolean"
    near = into.where("n = 1").select("id", "up")
    ups = near.select("up").distinct()  # many point to few: what they point to is looked up once
    ids = above.select(F.col("id").alias("up"), "n").join(ups, "up", "left_semi")
    now = near.join(ids, "up", "left").select("id", "up", F.lit(1).alias("far"), F.col("n").isNull().alias("root"), (F.coalesce("n", F.lit(0)) != 1).alias("done"))
    while True:
        seen = Observation()
        now.observe(seen, F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).write.parquet(f"{base}/round={rounds}")
        got = spark.read.schema(f"{schema}, round int").parquet(base)
        if not seen.get["open"] or rounds and not seen.get["done"]:
            return got.where("done").select("id", "up", "far", "root"), rounds
        # open pointers of this round, and what they point to: open ones of this round, or ones that have ended
        front = got.where((F.col("round") == rounds) & ~F.col("done"))
        to = got.where(F.col("done") | (F.col("round") == rounds)).select(F.col("id").alias("up"), F.col("up").alias("then"), F.col("far").alias("more"), F.col("root").alias("ends_root"), F.col("done").alias("ends"))
        to = to.join(front.select("up").distinct(), "up", "left_semi")
        now = front.join(to, "up").select("id", F.col("then").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("ends_root").alias("root"), F.col("ends").alias("done"))
        rounds += 1


def components(links: DataFrame) -> DataFrame:
    """id, component (its least id) of all ids in links (a, b): edges are hung on least neighbours until they form stars."""
    edges = step(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))  # v < u
        own = least.where("u != m").select("u", F.col("m").alias("v"))
        large = step(large.where("u != v").unionByName(own).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(step(least, "least"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = step(hung.where("u != v").distinct(), "links")
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        edges = now
        if per.where("up > 1 OR up > 0 AND root > 0").isEmpty():
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().join(stars.select("id"), "id", "left_anti")
    return stars.unionByName(centres.select("id", F.col("id").alias("component")))


#: Hops that are walked one by one before paths double.
HOPS = 4


def closure(edges: DataFrame, start: DataFrame, down: bool = True, include_self: bool = False) -> DataFrame:
    """start, id: everything reached from each start id over one edge or more (or none, with ``include_self``)."""
    return closure_in_rounds(edges, start, down, include_self)[0]


def closure_in_rounds(edges: DataFrame, start: DataFrame, down: bool = True, include_self: bool = False) -> tuple[DataFrame, int]:
    """The closure, and how many rounds have found pairs.

    The first hops are walked one by one, which is all that shallow hierarchies need. Then paths double: with all pairs up to
    2^k edges apart known, one join with the ends of walks of just 2^k edges gives those up to twice as far, so rounds grow
    with the logarithm of the depth. A round without a new pair ends it, on cycles too, since the first node further away
    would lie at just one edge more. Every pair is written once, to a part of one table that plans read as a whole.
    """
    spark = edges.sparkSession
    a, b = ("parent", "child") if down else ("child", "parent")
    hop = step(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "hops")
    base, rounds = step_path(spark, "pairs"), 0
    here = start.select(F.col("id").alias("start"), "id").distinct()
    front = here if include_self else here.join(hop, "id").select("start", F.col("next").alias("id")).distinct()

    def write(pairs: DataFrame) -> DataFrame:
        pairs.write.parquet(f"{base}/round={rounds}")
        return read(f"{base}/round={rounds}")

    def read(path: str) -> DataFrame:
        return spark.read.schema("start string, id string").parquet(path).select("start", "id")

    def further(pairs: DataFrame, hops: DataFrame) -> DataFrame:
        return pairs.join(hops, "id").select("start", F.col("next").alias("id")).distinct().join(read(base), ["start", "id"], "left_anti")

    front = write(front)
    while not front.isEmpty():
        rounds += 1
        if rounds < HOPS + include_self:
            front = write(further(front, hop))
            continue
        # walks of as many edges as are known: four at first, then twice as many each time
        for _ in range(HOPS.bit_length() - 1 if rounds == HOPS + include_self else 1):
            hop = step(hop.join(hop.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")).distinct(), "hops")
        front = write(further(read(base), hop))
    return read(base), rounds


def least_reachable(edges: DataFrame, start: DataFrame, items: DataFrame, limit: int, down: bool = True, include_self: bool = False) -> DataFrame:
    """start, items: of the items (id, item) of all that a start id reaches, the least ``limit``, each once, in order.

    No pair of start and reached id is made: every node keeps the least items of itself and all behind it, and hands them on to
    the nodes before it when they change. The least of a union are the least of the parts' least, so what is cut off
    could never come in again, and an item that comes by several paths is one item. A round writes the lists that
    changed only; a node's last one counts. Rows are at most ``limit`` an edge and round; rounds are the length of the
    longest path on which anything changes. Cycles end by themselves.
    """
    a, b = ("parent", "child") if down else ("child", "parent")
    hop = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    # one source for all starts: what is reached at all
    ids = start.select("id").distinct()
    region = closure_of_all(hop, ids)
    hop = step(hop.join(region, "id", "left_semi"), "hops")
    base, rounds = step_path(edges.sparkSession, "least"), 0
    first = _least(items.select("id", "item").join(region, "id", "left_semi"), "id", limit)
    shape = StructType([*first.schema.fields, StructField("round", IntegerType())])

    def write(lists: DataFrame) -> DataFrame:
        lists.write.parquet(f"{base}/round={rounds}")
        return edges.sparkSession.read.schema(shape).parquet(f"{base}/round={rounds}").select("id", "items")

    def every() -> DataFrame:
        return edges.sparkSession.read.schema(shape).parquet(base)

    changed = write(first)
    while not changed.isEmpty():
        came = hop.join(changed.select(F.col("id").alias("next"), "items"), "next").select("id", F.explode("items").alias("item"))
        to = _least(came, "id", limit).withColumnRenamed("items", "new")
        both = to.join(every(), "id", "left").groupBy("id").agg(F.max_by("items", "round").alias("last"), F.any_value("new").alias("new"))
        both = both.select("id", F.coalesce("last", F.expr("filter(new, x -> false)")).alias("old"), "new")
        merged = both.select("id", "old", F.slice(F.array_sort(F.array_union("old", "new")), 1, limit).alias("items"))
        rounds += 1
        changed = write(merged.where(F.col("old") != F.col("items")).select("id", "items"))
    kept = every().groupBy("id").agg(F.max_by("items", "round").alias("items"))
    if include_self:
        return kept.join(ids, "id", "left_semi").withColumnRenamed("id", "start")
    came = ids.join(hop, "id").join(kept.withColumnRenamed("id", "next"), "next").select("id", F.explode("items").alias("item"))
    return _least(came, "id", limit).withColumnRenamed("id", "start")


def closure_of_all(hop: DataFrame, ids: DataFrame) -> DataFrame:
    """id: the ids and all that they reach over hops (id, next), each once and written once; a null id reaches nothing."""
    spark, base, rounds = hop.sparkSession, step_path(hop.sparkSession, "reached"), 0

    def write(front: DataFrame) -> DataFrame:
        front.write.parquet(f"{base}/round={rounds}")
        return read(f"{base}/round={rounds}")

    def read(path: str) -> DataFrame:
        return spark.read.schema(front.schema).parquet(path).select("id")

    front = ids.select("id").where("id IS NOT NULL").distinct()
    front = write(front)
    while not front.isEmpty():
        rounds += 1
        reached = front.join(hop, "id").select(F.col("next").alias("id")).where("id IS NOT NULL").distinct()
        front = write(reached.join(read(base), "id", "left_anti"))
    return read(base)


def _least(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The least ``limit`` different items of each, in order; tasks cut theirs before the shuffle."""
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy(by).orderBy("item"))).where(F.col("nth") <= limit)
    return ranked.groupBy(by).agg(F.array_sort(F.collect_set("item")).alias("items"))


def collapse(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct edges between the representatives of blocks (id, block), without loops; an unknown id stands for itself."""
    a, b = (blocks.select(F.col("id").alias(c), F.col("block").alias(f"__{c}")) for c in ("parent", "child"))
    both = edges.join(a, "parent", "left").join(b, "child", "left")
    both = both.select(F.coalesce("__parent", "parent").alias("parent"), F.coalesce("__child", "child").alias("child"))
    return both.where("parent != child").distinct()


def representatives(blocks: DataFrame) -> DataFrame:
    """id, block: every block named by its least id."""
    # written, so that few names are known to be few and a large block's rows stay in their tasks
    least = step(blocks.groupBy("block").agg(F.min("id").alias("least")), "least")
    return blocks.join(least, "block").select("id", F.col("least").alias("block"))
