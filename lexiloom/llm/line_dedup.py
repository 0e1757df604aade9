"""Line dedup by distinct-site spread, in DataFrame expressions only.

A line (trimmed of spaces, twelve code points at least) is known by its 64-bit hash. One pass drops every line that one site
alone has, by the least and greatest site hash (two numbers a line, combined before the shuffle). For the others the sites
are counted with a HyperLogLog sketch for each line and document range, the sketches of a line are merged by a second
aggregation, and a line whose estimate lies near the threshold gets an exact distinct count. A line on at least
``min_sites`` sites is cross-site boilerplate: it goes from every document but for its first occurrence (least doc_id,
then least line number, then least text hash), so that text which many sites copy is kept once and no content is lost.

Defined results: a null or empty text has one empty line, which is never boilerplate; null sources are one site; a
document that loses every line stays with an empty text; rows of one doc_id and text are treated alike, different
texts under one doc_id or under none are apart (a document is known by its id and its text's 64-bit hash); a text of one
very long line is one line; an empty table gives no rows; other columns stay as they are. Two lines of equal hash count as
one line: at n lines of which b are boilerplate, n * b / 2**64 lines are expected to go by mistake.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, numbered, table, whole_text

MIN_SITES = 5
#: Shorter lines say too little to be told from chance.
MIN_CHARS = 12
LG_K = 12
#: Three standard errors of a sketch of 2**12 registers, and one site for rounding.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)


def lines_of(text: Column) -> Column:
    return F.split(text, F.lit("\n"), -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def long_enough(line: Column, min_chars: int) -> Column:
    """At least ``min_chars`` code points in the trimmed line."""
    return F.length(F.trim(line)) >= min_chars


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, copy (the text's hash), site, pos, line_hash of every line that can be boilerplate."""
    site = F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")))
    lines = docs.select("doc_id", F.xxhash64(whole_text()).alias("copy"), site.alias("site"), F.posexplode(lines_of(whole_text())).alias("pos", "line"))
    return lines.where(long_enough(F.col("line"), min_chars)).select("doc_id", "copy", "site", "pos", line_key(F.col("line")).alias("line_hash"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines on two sites or more, and the hashes of boilerplate with their first occurrence."""
    every = occurrences(docs, min_chars)
    shared = every.groupBy("line_hash").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a < b").select("line_hash")
    # written first, so that the join meets two tables and can split a hot line's rows over tasks
    seen = cut(every.join(cut(shared, "shared"), "line_hash", "left_semi"), "lines")
    # sketches for each line and range of documents, then merged: no line's occurrences meet in one task
    part = seen.groupBy("line_hash", F.pmod(F.hash("doc_id", "copy"), F.lit(16)).alias("part")).agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "pos", "copy")).alias("first")
    )
    spread = part.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"), F.min("first").alias("first"))
    low, high = int(min_sites / (1 + BAND)) - 1, min_sites * (1 + BAND) + 1
    spread = cut(spread.where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high)
    exact = _exact(seen, near)
    sure = spread.where(F.col("sites") > high).select("line_hash", "first")
    found = near.join(exact.where(F.col("exact_sites") >= min_sites), "line_hash").select("line_hash", "first")
    return seen, cut(sure.unionByName(found), "boilerplate")


def _exact(seen: DataFrame, near: DataFrame) -> DataFrame:
    """Exact distinct sites of the lines near the threshold: distinct pairs first, then a count."""
    pairs = seen.join(near.select("line_hash"), "line_hash", "left_semi").select("line_hash", "site").distinct()
    return pairs.groupBy("line_hash").agg(F.count(F.lit(1)).alias("exact_sites"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with cross-site boilerplate taken out of ``text``, and a column ``lines_removed`` (``lines_removed_`` where docs has one)."""
    seen, found = boilerplate(docs, min_sites, min_chars)
    hit = seen.join(found, "line_hash")
    is_first = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.pos") == F.col("pos")) & (F.col("first.copy") == F.col("copy"))
    # by document: what to take out, and the places that stay
    plan = hit.groupBy(F.col("doc_id").alias("id"), "copy").agg(
        F.collect_set("line_hash").alias("out"), F.collect_set(F.when(is_first, F.col("pos"))).alias("stay")
    )
    rows, names = numbered(docs)
    doc_id, text = (rows.columns[names.index(c)] for c in ("doc_id", "text"))
    both = rows.join(plan, rows[doc_id].eqNullSafe(plan["id"]) & (F.xxhash64(whole_text(text)) == plan["copy"]), "left")
    marked = F.transform(
        lines_of(whole_text(text)),
        lambda line, i: F.struct(
            line.alias("line"),
            (long_enough(line, min_chars) & F.array_contains("out", line_key(line)) & ~F.array_contains("stay", i)).alias("out"),
        ),
    )
    both = both.withColumn("marked", F.when(F.col("out").isNotNull(), marked))
    kept = F.array_join(F.transform(F.filter("marked", lambda m: ~m["out"]), lambda m: m["line"]), "\n")
    removed = F.coalesce(F.size(F.filter("marked", lambda m: m["out"])), F.lit(0))
    changed = F.col("marked").isNotNull()
    return both.select(
        *[F.when(changed, kept).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in rows.columns],
        F.when(changed, removed).otherwise(0).cast("long").alias("removed"),
    ).toDF(*names, fresh("lines_removed", names))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after cross-site boilerplate removal, as digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = drop_boilerplate(docs)
    return done.select(
        "doc_id", "lines_removed", F.length(whole_text()).cast("long").alias("kept_chars"), F.sha2(whole_text(), 256).alias("kept_sha256")
    )


OP2_SQL = """
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(line, ' ') AS t FROM l),
e AS (SELECT *, length(t) >= 12 AS ok FROM k),
b AS (SELECT t, min((doc_id, pos)) AS first FROM e WHERE ok GROUP BY t HAVING count(DISTINCT site) >= 5),
m AS (SELECT e.*, b.t IS NOT NULL AND e.ok AND (e.doc_id, e.pos) <> b.first AS gone FROM e LEFT JOIN b ON e.t = b.t)
SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS lines_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
