import zlib

import numpy as np

from lexiloom.llm import quality as q


def test_column_is_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = q.fit(docs, labels)
    assert 1 <= len(model.rules) < 200
    rows = q.with_statistics(q.with_scores(docs, model)).toPandas()
    x = rows[[f"__s_{k}" for k in q.NAMES]].to_numpy()
    assert np.allclose(model.score(x), rows.score, atol=1e-9)
    both = rows.merge(labels.toPandas(), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id])
    right = (both.score >= q.THRESHOLD) == (both.quality == 1)
    assert right[out].mean() > 0.9
    clean = both[out & (both.quality == 1)]
    assert (clean.score >= q.THRESHOLD).mean() > 0.95


def test_lasso_finds_the_rule():
    r = np.random.default_rng(1)
    x = r.random((3000, len(q.NAMES)))
    y = ((x[:, 2] > 0.3) & (x[:, 5] <= 0.6)).astype(float)
    model = q.fit_rows(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_odd(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "word " * 50000, "y"), (1, None, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.fit(docs, none)
    docs = docs.selectExpr("*", "1 as __row", "2 as `a.b`", "3 as __s_length")
    out = q.with_scores(docs, model)
    got = out.collect()
    assert out.columns == [*docs.columns, "score_"] and len(got) == 4 and all(r.score_ > 0.99 for r in got) and {r.score for r in got} == {"x", "y"}
    kept = q.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert q.with_scores(docs.limit(0), model).count() == 0


def test_sample_bounds_rows(spark):
    """Many documents under one labelled id: the rows learnt from are bounded, not the labels only."""
    docs = spark.range(500).selectExpr("id % 5 as doc_id", "concat('text number ', id) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    seen = []
    keep = q.fit_rows
    q.fit_rows = lambda x, y: seen.append(len(y)) or keep(x, y)
    try:
        q.fit(docs, labels, sample=40)
    finally:
        q.fit_rows = keep
    assert 0 < seen[0] <= 40
