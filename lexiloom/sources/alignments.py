"""Alignment files and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)


def _column(df: DataFrame, name: str, default: str):
    """A missing column has the default; an empty cell is the empty text."""
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit(default)


def pairs(df: DataFrame) -> DataFrame:
    """Generic dialect: source, source_uri, target, target_uri and a relation; only the relation is trimmed."""
    relation = next((c for c in ("Relation", "relation") if c in df.columns), None)
    label = F.trim(F.coalesce(F.col(relation), F.lit(""))) if relation else F.lit("1")
    return df.select(
        F.struct(_column(df, "source", "").alias("code"), _column(df, "source_uri", "").alias("uri")).alias("src"),
        F.struct(_column(df, "target", "").alias("code"), _column(df, "target_uri", "").alias("uri")).alias("tgt"),
        label.alias("label"),
    )


#: A string in single or double quotes, a number or a name; a tuple of such. Fixed by the notation.
_STRING = r"""(?:'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")"""
_ATOM = rf"(?:{_STRING}|[-+]?[0-9][0-9.eE+-]*|None|True|False)"
_TUPLE = rf"(?:\(\s*{_STRING}\s*,\s*(?:{_ATOM}(?:\s*,\s*{_ATOM})*\s*,?)?\s*\))"
_ITEM = rf"(?:{_STRING}|{_TUPLE})"
_INSIDE = rf"\s*(?:{_ITEM}(?:\s*,\s*{_ITEM})*\s*,?)?\s*"
LIST = rf"^\s*(?:\[{_INSIDE}\]|\(\s*\)|\(\s*{_ITEM}\s*,{_INSIDE}\))\s*$"
#: Pieces of a string's inside: escapes by code point, by octal number, other escapes, plain text.
_PIECES = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+"
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "r": "\r", "t": "\t", "a": "\x07", "b": "\b", "f": "\f", "v": "\x0b", "\n": ""}


def _unquoted(literal: Column) -> Column:
    """The text that a quoted string stands for."""
    inside = F.substring(literal, F.lit(2), F.length(literal) - 2)

    def plain(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(2), F.length(piece))
        point = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        out = F.when(~piece.startswith("\\"), piece).when(rest.rlike("^[xuU][0-9a-fA-F]{2,8}$"), point(F.substring(rest, F.lit(2), F.length(rest))))
        out = out.when(rest.rlike("^[0-7]{1,3}$"), point(F.conv(rest, 8, 16)))
        for mark, text in _ESCAPES.items():
            out = out.when(rest == F.lit(mark), F.lit(text))
        return out.otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(_PIECES), F.lit(0)), plain), "")


def read_list(cell: Column) -> Column:
    """The strings of a list or tuple literal, of a tuple inside it the first; null where the cell is no such literal."""
    inside = F.regexp_extract(cell, r"^\s*[\[(]([\s\S]*)[\])]\s*$", 1)
    items = F.regexp_extract_all(inside, F.lit(_ITEM), F.lit(0))
    return F.when(cell.rlike(LIST), F.transform(items, lambda x: _unquoted(F.regexp_extract(x, _STRING, 0))))


def _cells(df: DataFrame) -> DataFrame:
    cell = {c: F.trim(_column(df, c, "")).alias(c) for c in ("src_code", "src_ety", "tgt_code", "tgt_ety", "score")}
    given = F.trim(_column(df, "tgt_cands", "[]"))
    return df.select(*cell.values(), given.alias("given"), F.when(given == "", F.array().cast("array<string>")).otherwise(read_list(given)).alias("listed"))


def unread_candidates(df: DataFrame) -> DataFrame:
    """src_code, tgt_code, given: the rows whose candidates are no list literal."""
    return _cells(df).where("listed IS NULL").select("src_code", "tgt_code", "given")


def candidate_pairs(df: DataFrame) -> DataFrame:
    """Candidate dialect: one row a candidate URI, labelled 1 where it is the target and the score says '1'.

    Candidates are a list literal; an empty list or cell means the declared target. A cell that is no list gives no pair:
    ``unread_candidates`` has it. ``declared`` is the target node as the row states it.
    """
    cells = _cells(df).where("listed IS NOT NULL")
    listed = F.when(F.size("listed") == 0, F.array("tgt_ety")).otherwise(F.col("listed"))
    rows = cells.withColumn("cand", F.explode(listed))
    return rows.select(
        F.struct(F.col("src_code").alias("code"), F.col("src_ety").alias("uri")).alias("src"),
        F.struct(F.substring_index("cand", "#", -1).alias("code"), F.col("cand").alias("uri")).alias("tgt"),
        F.when((F.col("cand") == F.col("tgt_ety")) & (F.col("score") == "1"), "1").otherwise("0").alias("label"),
        F.struct(F.col("tgt_code").alias("code"), F.col("tgt_ety").alias("uri")).alias("declared"),
    )


def load(spark: SparkSession, path: str, dialect: str = "generic") -> DataFrame:
    return candidate_pairs(read_csv(spark, path)) if dialect == "ncit-doid" else pairs(read_csv(spark, path))


def nodes(alignment: DataFrame, side: str) -> DataFrame:
    """Distinct nodes of a side (src or tgt); declared targets where the dialect has them, never its candidates."""
    if side == "tgt" and "declared" in alignment.columns:
        side = "declared"
    return alignment.select(f"{side}.*").distinct()
