"""Schemas of the data model. Readers state them; nothing is inferred."""

from pyspark.sql import types as T

NODE = T.StructType([T.StructField("code", T.StringType()), T.StructField("uri", T.StringType())])
ALIGNMENT = T.StructType([T.StructField("src", NODE), T.StructField("tgt", NODE), T.StructField("label", T.StringType())])
TERMS = ("parents", "children", "synonyms", "labels")
DICTIONARY = T.StructType([T.StructField("concept_code", T.StringType()), *[T.StructField(k, T.ArrayType(T.StringType())) for k in TERMS]])
API_METRICS = T.StructType([T.StructField(k, T.LongType()) for k in ("input_token", "output_token", "api_calls")])
PREDICTION = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("source_label", "target_label", "source", "source_uri", "target", "target_uri")]
    + [T.StructField("similarity", T.DoubleType())]
    + [T.StructField(k, T.IntegerType()) for k in ("confidence", "true_relation", "pred_relation")]
    + [T.StructField("api_metrics", API_METRICS), T.StructField("accepted", T.BooleanType())]
)
REVIEW = T.StructType([T.StructField(k, T.StringType()) for k in ("source", "target", "expert_edge")])
TRIPLE = T.StructType([T.StructField(k, T.StringType()) for k in ("graph", "s", "p", "o", "lang")])
CONCEPT_EDGE = T.StructType([T.StructField(k, T.StringType()) for k in ("concept", "start_label", "end_label", "rel_label")] + [T.StructField("weight", T.DoubleType())])
EDGE = T.StructType([T.StructField("parent", T.StringType()), T.StructField("child", T.StringType())])
RANK = T.StructType([T.StructField("id", T.StringType()), T.StructField("rank", T.IntegerType())])
CLASS = T.StructType([T.StructField("id", T.StringType()), T.StructField("block", T.StringType())])
DELTA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("u", T.StringType()), T.StructField("v", T.StringType()), T.StructField("pred", T.IntegerType())])
ANSWER = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("round", T.IntegerType()), T.StructField("agent", T.IntegerType()), T.StructField("response", T.StringType())])
PRICE = T.StructType([T.StructField("backend", T.StringType()), T.StructField("model", T.StringType()), T.StructField("usd_in", T.DoubleType()), T.StructField("usd_out", T.DoubleType())])
METRICS = T.StructType([T.StructField(k, T.DoubleType()) for k in ("precision", "recall", "f1")])
