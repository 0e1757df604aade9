import hashlib
import sys
from pathlib import Path

import duckdb

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import corpus_pipeline as p
import oracle
from test_minhash import brute
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lexiloom.llm import bpe, chat_format, line_dedup, mixing

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = p.quality_stage(spark, docs, DIR).cache()
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q]
    junk = [i for i, q in labels.items() if not q]
    assert sum(i in left for i in clean) >= 0.98 * len(clean) and sum(i in left for i in junk) <= 0.05 * len(junk)

    lines = p.line_stage(spark, good, DIR).cache()
    assert lines.columns == docs.columns and lines.count() == good.count()
    texts = {r.doc_id: r.text for r in lines.collect()}
    con = duckdb.connect()
    con.register("documents", good.toPandas())
    want = dict(con.execute(f"select doc_id, kept_sha256 from ({line_dedup.OP2_SQL})").fetchall())
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == want

    near = p.near_stage(spark, lines, DIR).cache()
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(brute(list(texts.items())).values()))

    mix = p.mix_stage(spark, near, DIR).cache()
    assert mix.columns == docs.columns
    con = duckdb.connect()
    con.register("documents", near.toPandas())
    taken = {i: n for i, n in con.execute(f"select doc_id, taken from ({mixing.OP8_SQL}) where taken > 0").fetchall()}
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == taken

    tok = Tokenizer.from_file(bpe.word_bpe())
    out = p.bpe_stage(spark, mix, DIR).collect()
    want = sorted((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids)) for r in mix.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want


def test_oracles(spark):
    for query, sql in ((line_dedup.op2_line_dedup, line_dedup.OP2_SQL), (chat_format.op6_chat_format, chat_format.OP6_SQL), (mixing.op8_mix_sources, mixing.OP8_SQL)):
        assert not oracle.differ(query(spark, DIR), sql, DIR)


def odd(spark, n=1):
    rows = [(1, None, "s1"), (2, "", None), (2, "", None), (3, "one line of words\n" * 50, ""), (None, "a b c d", "s1"), (4, "x " * 30000, "\U0001f600"), (4, "x " * 30000, "\U0001f600"), (5, " \t\n ", "s1")]
    return spark.createDataFrame([(*r, 0, 1.5) for r in rows] * n, "doc_id long, text string, source string, size int, key double")


def test_odd_mix(spark):
    df = odd(spark)
    got = mixing.mix_sizes(df).collect()
    assert len(got) == df.count() and sum(r.taken for r in got) <= sum(r.size for r in got) + 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_sizes(df.limit(0)).count() == 0
    assert sorted(map(tuple, mixing.mix_sizes(df.repartition(3)).select("doc_id", "taken").collect()), key=str) == sorted(((r.doc_id, r.taken) for r in got), key=str)


def test_clashing_columns(spark):
    df = odd(spark).selectExpr("*", "1 as __n", "2 as `a.b`", "3 as __id", "'u' as lines_removed", "7 as n")
    out = line_dedup.drop_boilerplate(df)
    assert out.columns == [*df.columns, "lines_removed_"] and {r.lines_removed for r in out.collect()} == {"u"}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {(r["__n"], r["a.b"], r["__id"], r["n"]) for r in mixed.collect()} == {(1, 2, 3, 7)}


def test_odd_lines(spark):
    df = odd(spark).withColumnRenamed("key", "pos")
    out = line_dedup.drop_boilerplate(df)
    assert out.columns == [*df.columns, "lines_removed"] and out.count() == df.count()
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0
    rows = [(i, f"own line number {i} here\nthe same boilerplate line {i % 2}\n\nmore", f"s{i % k}") for k, r in ((4, range(0, 20)), (5, range(20, 40))) for i in r]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].lines_removed == 0 and out[1].lines_removed == 0 and out[2].lines_removed == 1
    assert out[2].text == "own line number 2 here\n\nmore"
    rows = [(i, f"Impressum|Kontakt\n这是一个没有空格的重复的行\nshort one\nown {i} words", f"s{i}") for i in range(6)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].lines_removed == 0 and all(out[i].text == f"short one\nown {i} words" for i in range(1, 6))
    # texts without id, or different ones under one id, are apart; rows of one id and text are alike
    for key in (None, 7):
        rows = [(key, f"own line number {i} here\nthe same boilerplate line\n{'x' * i}", f"s{i % 6}") for i in range(12)] * 2 + [(9, "the same boilerplate line", "s0")]
        out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
        kept = [r.text for r in out if r.doc_id == key and "boilerplate" in r.text]
        assert len(out) == 25 and len(kept) == 2 and len(set(kept)) == 1
        assert sorted(r.text.split("\n")[0] for r in out if r.doc_id == key) == sorted(r[1].split("\n")[0] for r in rows if r[0] == key)
        assert [r.text for r in out if r.doc_id == 9] == [""]


def test_odd_chats(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, 2, "user", "a\\</s>"), (1, 3, "assistant", "<sep>"), (1, 4, "assistant", "\\<sep>\n"), (None, None, "x\n[INST]", "t"), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat_format.read_turns(out["formatted"]).alias("turns"), chat_format.read_loss(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", "a\\</s>"), ("user", "b"), ("assistant", "<sep>"), ("assistant", "\\<sep>\n")]
    assert got[1].loss == "<sep>\\<sep>\n" and got[1].formatted.count("</s>") == 3
    assert [tuple(t) for t in got[None].turns] == [("x\n[INST]", "t")] and got[3].loss == ""
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_null_and_empty_source_mix(spark):
    """A null source and one without name are two sources, in what is planned and in what is mixed."""
    words = "one two three four five six"
    rows = [(1, words, None), (1, words, ""), (2, words + " x", "a"), (3, "y " * 30, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r.doc_id, None if r.no_source else r.source_key): r.taken for r in mixing.mix_sizes(df).collect()}
    taken = dict.fromkeys(plan, 0)
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.source] += len(r.text.split())
    assert taken == plan


def test_tied_turns_by_text(spark):
    df = spark.createDataFrame([(1, 1, "user", "<s>"), (1, 1, "user", "<a")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()
    assert [t.text for t in out.t] == ["<a", "<s>"]


def test_mix_deals_texts_once(spark):
    """The join and the numbers of equal rows share one shuffle by key; equal rows share a cut as before."""
    rows = [(i, f"w{i} " * 5, "a") for i in range(20)] + [(7, "x y z", "b")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).collect()}
    want = {r.source_key: int(r.target + 0.5) for r in mixing.mix_sizes(docs).select("source_key", "target").distinct().collect()}
    assert taken == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum("Exchange hashpartitioning(key" in line for line in lines) == 2
