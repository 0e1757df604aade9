"""Mixing sources to target weights, in DataFrame expressions only.

Every document gets a hash-random key (md5 of seed, id and text digest). Within a source, documents are dealt by the first three hex
digits of the key into 4096 ranges; sizes are summed inside a range and over the ranges before it, which gives the prefix
sum in key order without ever bringing a source together in one task. The budget of a source cuts that order exactly: all
documents are repeated for every whole epoch in the budget, the rest of the budget takes documents from the front, the
last of them in part.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; they share 100 % of all sizes. No target exceeds
three times its source's size; what is cut off is shared anew by weight until none is above. That is a water level: the
target is min(3 * size, level * weight), and the level is found in one ordered pass over the sources.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are taken
0 times; repeated rows are documents of their own; ties of key go by id and size; an empty table gives no rows; other
columns are carried by mix() and ignored by mix_sizes(). The table of sources (one row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table, whole_text

WORD = r"[^\x20\x09-\x0D]+"
SEED = "lexiloom-mix-1"
MAX_EPOCHS = 3


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """no_source, source_key, source_size -> with target, the words a source shall give (double)."""
    order = Window.orderBy("no_source", "source_key")
    every = Window.partitionBy()
    rank = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    rank = rank.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("fill", F.col("cap") / F.col("weight"))
    level = Window.orderBy("fill", "no_source", "source_key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    rank = rank.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after),
    )
    rank = rank.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"])
    return rank.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))


def _key(seed: str, doc_id: Column, text: Column) -> Column:
    """Hash-random: rows without id, or of one id, part company by their texts."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))


def mix_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, no_source, source_key, key, size, source_size, target, epochs (whole ones), part (words from the last), taken."""
    base = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        _key(seed, F.col("doc_id"), whole_text()).alias("key"),
        words_in(whole_text()).alias("size"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    per = base.groupBy("no_source", "source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(per.groupBy("no_source", "source_key").agg(F.sum("bucket_size").alias("source_size")))
    ahead = Window.partitionBy("no_source", "source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    inside = (
        Window.partitionBy("no_source", "source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    out = (
        base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(per.drop("bucket_size"), ["no_source", "source_key", "bucket"])
        .join(goal, ["no_source", "source_key"])
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside"))).cast("long")
    return out.withColumn("part", part).withColumn("taken", F.col("size") * F.col("epochs") + F.col("part"))



def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a row for every epoch a document is in; the last one in part is cut behind its last word."""
    keys = ["key", "no_src", "src"]
    # rows that repeat id, text and source follow one another: their parts are full ones, one cut, then none, so their sum says all
    plan = mix_sizes(docs, seed).groupBy("key", F.col("no_source").alias("no_src"), F.col("source_key").alias("src"))
    plan = plan.agg(F.max("size").alias("size"), F.max("epochs").alias("epochs"), F.sum("part").alias("parts"))
    plan = plan.where((F.col("epochs") > 0) & (F.col("size") > 0) | (F.col("parts") > 0))
    rows, names = numbered(docs)
    doc_id, text, source = (rows.columns[names.index(c)] for c in ("doc_id", "text", "source"))
    of = {"key": _key(seed, F.col(doc_id), whole_text(text)), "no_src": F.col(source).isNull(), "src": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    # a text is dealt by its key once, for the join and the numbers after it
    both = _counted_in(rows.withColumns(of).join(plan, keys), keys, F.lit(0))
    epochs = F.col("epochs")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("parts") - (F.col("n") - 1) * F.col("size"))).cast("long")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), epochs.cast("int")),
        F.when(part > 0, F.array(F.when(part < F.col("size"), part).otherwise(F.lit(-1).cast("long")))).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    out = both.select(*rows.columns, F.explode(copies).alias("take"))
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("take"), F.lit(1)).cast("int")), "")
    return out.withColumn(text, F.when(F.col("take") > 0, cut_text).otherwise(F.col(text))).drop("take").toDF(*names)


def _counted_in(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``df`` with ``n``, the number of a row among those of equal keys."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('lexiloom-mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source IS NULL AS no_source, coalesce(source, '') AS source_key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, no_source, source_key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) / CAST(sum(weight) OVER (ORDER BY fill, no_source, source_key
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM f),
v AS (SELECT level AS top FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1),
t AS (SELECT l.*, least(CAST(cap AS DOUBLE), top * weight) AS target FROM l, v),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY e.no_source, e.source_key ORDER BY d.key, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON (d.source IS NULL) = e.no_source AND coalesce(d.source, '') = e.source_key)
SELECT doc_id, size, source_size, target, CAST(size * epochs + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM p
"""
