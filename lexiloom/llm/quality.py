"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark expressions. Boosted trees of depth three are grown on a bounded sample of labelled rows, every
path from a root to a node becomes a conjunctive rule, and logistic regression with a lasso penalty keeps few of them. The
rules left and their weights are compiled into one Spark column expression, so scoring is a projection.

The sample: at most ``SAMPLE`` labelled rows of least md5(doc_id); their statistics alone go to the driver. Rows of the
held-out fold (crc32 of the id as text, modulo 4, is 2) are never learnt from. Label, language, source and id are no
statistics.

Defined results: null and empty texts are scored as a text of no characters; labels null or other than 0 and 1, and labels
of unknown documents, are passed over; several labels of one document are several samples; without labels of both kinds
every score is the share of label 1 (1 if there are none); rows repeated get equal scores; very long texts are read whole;
an empty table gives no rows; other columns, whatever their names, are carried by ``with_scores`` and ``accepted``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, table, whole_text

SAMPLE = 20_000
TREES, DEPTH, RATE, LEAST = 40, 3, 0.3, 20
BINS = 48
PENALTY = 0.0015
THRESHOLD = 0.7
NAMES = ["length", "space", "upper", "symbol", "pipe", "bang", "digit", "stop", "comma", "breaks", "distinct_words", "distinct_lines", "word_length"]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def statistics(text: str = "text") -> list[Column]:
    """The statistics in the order of NAMES, from whole texts."""
    t = whole_text(text)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")

    def share(sign: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))) / n

    def matches(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    words, lines = F.split(t, F.lit(" "), -1), F.split(t, F.lit("\n"), -1)
    blanks = share(" ") + share("\n")
    return [
        F.log1p(F.length(t).cast("double")), blanks, matches("[A-ZÀ-ÖØ-Þ]"), matches(r"[#$%&*+<=>@\\^_`{|}~]"), share("|"), share("!"), matches("[0-9]"),
        share("."), share(","), share("\n"), F.size(F.array_distinct(words)) / F.size(words), F.size(F.array_distinct(lines)) / F.size(lines),
        (F.lit(1.0) - blanks) * n / (blanks * n + 1),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns({f"__s_{k}": F.round(s, 6) for k, s in zip(NAMES, statistics(text), strict=True)})


# ---- learning, on the driver, over the bounded sample


def grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> list[tuple]:
    """One tree as nodes (path, rows, value); a path is a tuple of (statistic, above, threshold)."""
    out, rest = [], [((), np.arange(len(x)))]
    while rest:
        path, rows = rest.pop()
        g, h = grad[rows], hess[rows]
        leaf = True
        if len(path) < DEPTH and len(rows) >= 2 * LEAST:
            best = (1e-6, None, None)
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                c = codes[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, len(cut) + 1))[:-1] for w in (g, h, None))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] is not None:
                _, f, k = best
                above = codes[rows, f] > k
                rest += [((*path, (f, True, float(cuts[f][k]))), rows[above]), ((*path, (f, False, float(cuts[f][k]))), rows[~above])]
                leaf = False
        out.append((path, rows, -g.sum() / (h.sum() + 1) if leaf else None))
    return out


def boosted_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct paths of all trees, in order of growth."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(values[values < x[:, f].max()])
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        for path, rows, value in grow(x, codes, cuts, p - y, p * (1 - p)):
            if path:
                rules[_simple(path)] = None
            if value is not None:
                margin[rows] += RATE * value
    return list(rules)


def _simple(path: tuple) -> tuple:
    """The tightest bounds of a path, in order of statistic."""
    bound: dict[tuple, float] = {}
    for f, above, t in path:
        bound[f, above] = (max if above else min)(bound.get((f, above), t), t)
    return tuple((f, above, t) for (f, above), t in sorted(bound.items()))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression, L1 penalty, accelerated proximal gradient steps on scaled columns."""
    scale = np.maximum(z.std(axis=0), 0.02)
    mean = z.mean(axis=0)
    s = (z - mean) / scale
    n = len(y)
    v = np.ones(s.shape[1]) / np.sqrt(max(1, s.shape[1]))
    for _ in range(30):  # the greatest eigenvalue
        v = s.T @ (s @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * max(np.linalg.norm(s @ v) ** 2 / n, 1) + 0.25)
    w = u = np.zeros(s.shape[1])
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    k = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(s @ u + c))) - y
        w2 = u - step * (s.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        u, c = w2 + (k - 1) / k2 * (w2 - w), b2 + (k - 1) / k2 * (b2 - b)
        w, b, k = w2, b2, k2
    weights = w / scale
    return float(b - mean @ weights), weights


class RuleModel:
    """bias and [(rule, weight)]."""

    def __init__(self, bias: float, rules: list[tuple[tuple, float]]):
        self.bias, self.rules = bias, rules

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for rule, w in self.rules:
            margin += w * holds(rule, x)
        return 1 / (1 + np.exp(-margin))

    def column(self) -> Column:
        """The score over the statistics' columns."""
        margin = F.lit(self.bias)
        for rule, w in self.rules:
            test = None
            for f, above, t in rule:
                s = F.col(f"__s_{NAMES[f]}")
                one = s > F.lit(t) if above else s <= F.lit(t)
                test = one if test is None else test & one
            margin = margin + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_rows(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 1.0
        return RuleModel(40.0 if share else -40.0, [])
    rules = boosted_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    bias, weights = lasso(z, y)
    return RuleModel(bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learns from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y"))
    # the sample is bounded, so is what is broadcast
    picked = known.orderBy(F.md5(F.col("__id").cast("string")), "__id", "__y").limit(sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")))
    order = ["__id", "__y", *[f"__s_{k}" for k in NAMES]]
    # an id may have several documents: the bound holds for rows
    first = rows.select(*order).orderBy(F.md5(F.col("__id").cast("string")), *order).limit(sample)
    got = first.toPandas().sort_values(order)
    return fit_rows(got[[f"__s_{k}" for k in NAMES]].to_numpy(np.float64), got["__y"].to_numpy(np.float64))


def with_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with a column ``score`` (``score_`` where docs has one)."""
    rows, names = numbered(docs)
    out = with_statistics(rows, rows.columns[names.index("text")]).withColumn("score", model.column())
    return out.select(*rows.columns, "score").toDF(*names, fresh("score", names))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more.

    The row number keeps the filter above the projections: pushed below, it would hold the statistics once for every rule.
    """
    rows, names = numbered(docs)
    marked = with_statistics(rows, rows.columns[names.index("text")])
    marked = marked.withColumns({"score": model.column(), "row": F.monotonically_increasing_id()})
    return marked.where((F.col("score") >= threshold) & (F.col("row") >= 0)).select(*rows.columns).toDF(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
