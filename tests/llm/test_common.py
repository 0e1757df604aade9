import bisect
import random

from pyspark.sql import functions as F

from lexiloom.llm import common


def test_bucket_of(spark):
    r = random.Random(1)
    for n in (0, 1, 2, 3, 10, 50, 3000):
        cuts = sorted(r.sample(range(-5000, 5000), n))
        if n == 10:
            cuts[0] = -(2**63)
        keys = [r.randint(-6000, 6000) for _ in range(200)] + cuts[:50] + [None, -(2**63), 2**63 - 1]
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", common.bucket_of("k", cuts).alias("b")).collect()
        assert all(x.b == (0 if x.k is None else bisect.bisect_right(cuts, x.k)) for x in rows)


def test_order(spark):
    r = random.Random(2)
    keys = [r.randint(0, 500) for _ in range(400)] + [None, None]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "id long, t string")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        out = common.in_key_order(df, "id", "t", carry=True).withColumn("p", F.spark_partition_id()).collect()
        plain = common.in_key_order(df, "id", "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(((k, f"t{i}") for i, k in enumerate(keys)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x.id, x.t) for x in plain] == order and [(x.id, x.t) for x in out if not x.lead] == order
    for p in {x.p for x in out}:
        own = [(x.id, x.t) for x in out if x.p == p and not x.lead]
        lead = [(x.id, x.t) for x in out if x.p == p and x.lead]
        assert lead and lead[-1] == order[order.index(own[0]) - 1]


def test_by_part(spark):
    rows = spark.range(5).selectExpr("cast(id as int) as part").select("part", common.by_part({0: 7, 3: -(2**63)}).alias("v")).collect()
    assert {x.part: x.v for x in rows} == {0: 7, 1: None, 2: None, 3: -(2**63), 4: None}
