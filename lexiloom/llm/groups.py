"""Links and classes from buckets of candidates, without listing the pairs of a bucket.

Three rounds test candidates, and the components of the links found grow with each:

1. every member of a bucket with the bucket's least id;
2. in buckets whose members are not yet of one component, every member of another component with the bucket's best linked one;
3. what is still open: members outside a bucket's largest component (the strays) against all members of another component.
   Members are packed into blocks of bounded size by hash, and a block of strays meets each block of the bucket in one array
   operation of the operator's own, which passes on only pairs that may be links.

Where a share of the buckets is tested ahead of all (``starred``), only buckets that still hold several components are gathered at all:
near copies share hundreds of keys, and few of these are needed to make them one component.

Members of one component need no test, so a bucket of near copies costs one test a member; no pair of rows is made before the
third round's operation. A bucket of many strays (over ``MANY``) is refined first, where the operator has several keys a member:
its members meet under pairs of keys, then triples, and so on, so that members that share a key by chance part company while
those that are alike share many keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 256
#: Strays of a bucket from which on it is refined, and how often at most.
MANY, DEEP = 4096, 3


def _parts(rows: int) -> int:
    """Partitions for a table of so many short rows."""
    return max(8, rows // 50_000)


def components(links: DataFrame) -> DataFrame:
    """id, component (least id) of every id in links (a, b): large and small star steps until all edges form stars.

    Every step is written, with partitions by the number of links; the joins meet two written tables, so a hub's rows can be
    split over tasks.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    parts = _parts(edges.count())

    def write(df: DataFrame, name: str) -> DataFrame:
        return cut(df.coalesce(parts), name)

    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = write(small.where("u != v").distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("root") > 0)).isEmpty()


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) with more links (a, b): only the components that these join are worked on."""
    a, b = (found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    ends = links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    more = cut(components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))), "more")
    old = found.join(more.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    lone = more.join(found.select("id"), "id", "left_anti")
    return cut(old.select("id", F.coalesce("now", "component").alias("component")).unionByName(lone), "components")


def starred(postings: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the first round alone, on a share of the buckets, each of them whole: what ``linked`` takes as ``known``."""
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1").select("key", "hub")
    pairs = postings.join(cut(buckets, "buckets"), "key").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    pairs = cut(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = cut(verify(pairs, ids).where("good").select("a", "b", "like"), "links")
    return links, cut(components(links), "components")


def linked(
    postings: DataFrame, details: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame], meet: Callable, keys: DataFrame | None = None,
    known: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, like), components (id, component)): verified links between ids that share a bucket.

    postings: key, id, place (a number for ``meet``), a row at most for each key and id. details: id and what ``meet`` needs.
    verify(pairs, ids): pairs (a, b) with ``good`` and ``like``, where ids are all that will ever be asked for.
    meet(key, one, two): index pairs of rows of two blocks (dicts of id, component, place and the details) that may be links;
    rows of one component are none. keys: id, keys (all keys of a member), where buckets may be refined. known: links and components
    found before (``starred``); postings then have their component (the id where there is none), and buckets of one component are closed.
    """
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), *([F.min("component").alias("x"), F.max("component").alias("y")] if known else []))
    buckets = buckets.where("x != y" if known else "n > 1").select("key", "n", "hub")
    # small tables that meet hot keys are written first: the join then splits a hot key's rows over tasks
    members = cut(postings.join(cut(buckets, "buckets"), "key"), "members")
    parts = _parts(members.count())

    def write(df: DataFrame, name: str) -> DataFrame:
        return cut(df.coalesce(parts), name)

    ids = write(members.select("id").distinct(), "ids")

    def good(pairs: DataFrame) -> DataFrame:
        # what is compared is large beside the pairs: these tasks stay as many as the shuffle has
        return cut(verify(pairs, ids).where("good").select("a", "b", "like"), "links")

    pairs = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    if known:
        links, found = known
        of_a, of_b = (found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
        apart = pairs.join(of_a, "a", "left").join(of_b, "b", "left").where("coalesce(of_a, a) != coalesce(of_b, b)")
        more = good(apart.select("a", "b"))
        links, found = links.unionByName(more), extended(found, more)
    else:
        links = good(pairs)
        found = cut(components(links), "components")
    left = _open(members.select("key", "id", "place"), found, write)
    if left.isEmpty():
        return links, found
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").count()
    known = write(left.join(degree, "id", "left").withColumn("count", F.coalesce("count", F.lit(0))), "known")
    best = write(known.groupBy("key").agg(F.max(F.struct("count", "id", "component")).alias("top")), "best")
    pairs = known.join(best, "key").where("component != top.component").select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b"))
    more = good(pairs.distinct())
    links, found = links.unionByName(more), extended(found, more)
    left = _open(left.select("key", "id", "place"), found, write)
    if left.isEmpty():
        return links, found
    if keys is not None:
        left = _refined(left, keys, write)
    more = good(_crossing(left, details, meet, write))
    return links.unionByName(more), extended(found, more)


def _open(members: DataFrame, found: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key, id, place, component of the members of buckets that hold several components."""
    every = write(members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    return _contested(every, write)


def _contested(every: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    keys = every.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return write(every.join(write(keys, "keys"), "key", "left_semi"), "open")


def _tops(left: DataFrame) -> DataFrame:
    """key, its largest component, and how many members are of it or not."""
    counts = left.groupBy("key", "component").count()
    top = counts.groupBy("key").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("n"))
    return top.select("key", F.col("top.component").alias("major"), F.col("top.count").alias("n_major"), (F.col("n") - F.col("top.count")).alias("n_stray"))


def _refined(left: DataFrame, keys: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The open buckets, with those of many strays dealt into buckets of one more shared key, as often as it takes."""
    done = None
    for _ in range(DEEP):
        big = write(_tops(left).where(F.col("n_stray") > MANY).select("key"), "big")
        if big.isEmpty():
            break
        small = left.join(big, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        dealt = left.join(big, "key", "left_semi").join(keys, "id").select("key", "id", "place", "component", F.explode("keys").alias("__more"))
        both = F.xxhash64(F.least("key", "__more"), F.greatest("key", "__more"))
        dealt = dealt.where(F.col("key") != F.col("__more")).select(both.alias("key"), "id", "place", "component").distinct()
        left = _contested(cut(dealt, "dealt"), lambda df, name: cut(df, name))
    return left if done is None else write(done.unionByName(left), "refined")


def _blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _crossing(left: DataFrame, details: DataFrame, meet: Callable, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs (a, b) of one bucket and different components, one of them a stray, that ``meet`` lets through."""
    full = left.join(write(_tops(left), "tops"), "key").join(details, "id")
    stray = F.col("component") != F.col("major")
    n_own = F.when(stray, F.col("n_stray")).otherwise(F.col("n_major"))
    full = full.withColumn("stray", stray).withColumn("block", F.pmod(F.xxhash64("id"), _blocks_of(n_own)).cast("int"))
    columns = ["id", "component", "place", *(c for c in details.columns if c != "id")]
    packed = cut(full.groupBy("key", "stray", "block", "n_stray", "n_major").agg(F.collect_list(F.struct(*columns)).alias("rows")), "blocks")
    strays = F.sequence(F.lit(0), _blocks_of(F.col("n_stray")) - 1)
    # a block of strays meets every block of strays from itself on, and every other block of its bucket
    ahead = packed.where("stray").select(
        "key", F.col("block").alias("x"), F.col("rows").alias("one"),
        F.explode(
            F.concat(
                F.transform(F.sequence(F.col("block"), _blocks_of(F.col("n_stray")) - 1), lambda b: F.struct(F.lit(True).alias("stray"), b.alias("y"))),
                F.transform(F.sequence(F.lit(0), _blocks_of(F.col("n_major")) - 1), lambda b: F.struct(F.lit(False).alias("stray"), b.alias("y"))),
            )
        ).alias("to"),
    ).select("key", "x", "one", "to.stray", "to.y")
    met = packed.withColumn("x", F.explode(strays)).where("not stray or x <= block")
    met = met.select("key", "stray", "x", F.col("block").alias("y"), F.col("rows").alias("two"))
    pairs = ahead.join(met, ["key", "stray", "x", "y"]).select("key", "one", "two")
    return pairs.mapInArrow(_meeting(meet), "a long, b long").distinct()


def _meeting(meet: Callable):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, one, two = (batch.column(c)[r].as_py() for c in range(3))
                found = meet(key, one, two)
                if found:
                    ends = np.array([sorted((one[i]["id"], two[j]["id"])) for i, j in found], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return work
