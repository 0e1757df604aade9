"""MinHash near-dedup with ProbMinHash sketches.

Texts are sets of shingles of five words (white-space runs; a text of fewer words is one shingle), weighted by
1 + ln(count). Two texts are near copies when their likeness is 0.8 or more: the probability Jaccard likeness of the weighted
shingles, or that of the plain ones (all weights 1), whichever is greater. At weights of 1 it is the Jaccard likeness, so
repeats neither hide a copy nor are needed for one.

Every shingle is a Poisson process of rate weight: exponential gaps from its hash, each arrival at a register from the same
hash. A register keeps the shingle of its earliest arrival, and a process ends once its time is past the latest register's
(early termination), so equal registers of two texts estimate their probability Jaccard likeness. 180 registers make 36 bands
of five; texts that agree on a band are candidates, and each link is verified by the exact likenesses. A pair of either
likeness 0.8 misses every band of that sketch with probability 6e-7. Texts without a repeated shingle have one sketch for both.

Equal texts are one class from the start (128-bit text hash); sketches and links are between class representatives. Within
a bucket no pairs are listed: see ``groups.linked``. Its third round passes on pairs whose sizes, parity bitmaps (every shingle
flips the bit of its hash, so two bitmaps differ in no more bits than the sets in shingles) and plain sketches allow a plain
likeness of 0.8, or whose weighted sketches allow a weighted one; the sketches by ``ERRORS`` standard errors (1e-8 at 0.8), each
in the first bucket that the two share.

Defined results: null and empty texts are equal texts without shingles; white space only likewise has no shingle and is
like nothing but equal texts; documents are known by doc_id and text, so repeated rows are one document, and different texts
under one doc_id (or none) are classed apart; a null doc_id counts as the least; very long texts are hashed whole; an empty
table gives no rows; other columns, whatever their names, are ignored or carried by ``drop_near_duplicates``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches, table, whole_text
from .groups import linked

WORDS = 5
LIKENESS = 0.8
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
PARITY = 2048
#: Standard errors under the likeness at which a pair of sketches is given up.
ERRORS = 6
CACHE_WORDS = 200_000
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
NULL_ID = -(2**63)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words, those met lately kept."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def forget(self) -> None:
        """A worker that waits for other work holds no words."""
        self.known, self.older = {}, {}

    def one(self, word: str) -> int:
        h = self.older.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self.known[word] = h
        return h

    def hashes(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        words, get, one = text.split(), self.known.get, self.one
        return np.fromiter([get(w) or one(w) for w in words], np.uint64, len(words))


@functools.lru_cache(1)
def words() -> Words:
    return Words()


def shingles(text: str, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    w = words().hashes(text)
    if not len(w):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = max(1, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        h = h * _A + w[j : j + n]
    return np.unique(mixed(h + np.uint64(min(k, len(w)))), return_counts=True)


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """A row of m registers for every weighted set (hashes, counts) that is not empty."""
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    out = np.zeros((len(sets), m), np.uint64)
    # small sets need many arrivals of each element, large ones few
    for low, high, arrivals in ((1, 40, 32), (40, 200, 8), (200, 800, 3), (800, 1 << 62, 1)):
        some = np.flatnonzero((sizes >= low) & (sizes < high))
        if len(some):
            out[some] = _sketches([sets[i] for i in some], m, arrivals)
    return out


def _sketches(sets: list[tuple[np.ndarray, np.ndarray]], m: int, arrivals: int) -> np.ndarray:
    element = np.concatenate([h for h, _ in sets])
    rate = 1 + np.log(np.concatenate([c for _, c in sets]))
    row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    time = np.zeros(len(element))
    first = np.full(len(sets) * m, np.inf)
    who = np.zeros(len(sets) * m, np.uint64)
    n = 0
    while len(element):
        steps = np.arange(n + 1, n + 1 + arrivals, dtype=np.uint64) * _A
        r = mixed(element[:, None] + steps)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        place = row[:, None] * m + ((mixed(r ^ _C) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        use = at < first[place]
        at_used, place_used = at[use], place[use]
        np.minimum.at(first, place_used, at_used)
        won = at_used == first[place_used]
        who[place_used[won]] = np.broadcast_to(element[:, None], at.shape)[use][won]
        time = at[:, -1]
        # a process goes on while it may still come first somewhere
        on = time < first.reshape(-1, m).max(axis=1)[row]
        element, rate, row, time = element[on], rate[on], row[on], time[on]
        n += arrivals
    return who.reshape(-1, m)


def both_sketches(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches with all weights 1, and weighted ones; a set without repeats has the same for both."""
    plain = sketches([(h, np.ones(len(h))) for h, _ in sets])
    weighted = plain.copy()
    again = [i for i, (_, c) in enumerate(sets) if len(c) and c.max() > 1]
    if again:
        weighted[again] = sketches([sets[i] for i in again])
    return plain, weighted


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap in which every shingle has flipped one bit: two of them differ in no more bits than the sets in shingles."""
    n = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((n & 1).astype(np.uint8))


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band."""
    part = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _B
    for j in range(ROWS):
        h = mixed(h * _A + part[:, :, j])
    return h.view(np.int64)


def _sketch_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        plain, weighted = both_sketches(sets)
        apart = (plain != weighted).any(axis=1)
        first, more = band_keys(plain), band_keys(weighted)
        keys = [np.concatenate([a, b]) if x else a if len(h) else a[:0] for a, b, x, (h, _) in zip(first, more, apart, sets, strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        short, short_w = ((x & np.uint64(255)).astype(np.uint8) for x in (plain, weighted))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(h) for h, _ in sets], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))),
                pa.array([x.tobytes() for x in short], pa.binary()), pa.array([x.tobytes() if a else b"" for x, a in zip(short_w, apart, strict=True)], pa.binary()),
                pa.array([parity(h).tobytes() for h, _ in sets], pa.binary()),
            ],
            names=["id", "hash", "size", "keys", "sketch", "sketch_w", "parity"],
        )
    words().forget()


def _set_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        counts = [c.astype("<u4").tobytes() if len(c) and c.max() > 1 else b"" for _, c in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array(counts, pa.binary())], names=["id", "set", "counts"])
    words().forget()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets without repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two ascending sets with weights: over shared elements d, 1 / sum over all d' of max(x'/x, y'/y)."""
    if not len(a) or not len(b):
        return 0.0
    every = np.union1d(a, b)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a)], v[np.searchsorted(every, b)] = x, y
    # x'/x is the greater where x'/y' is at least x/y: sums of x' from there on, of y' before
    ratio = np.divide(u, v, out=np.full(len(every), np.inf), where=v > 0)
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    ahead, behind = np.concatenate([[0], np.cumsum(v)]), np.concatenate([np.cumsum(u[::-1])[::-1], [0]])
    shared = np.flatnonzero((u > 0) & (v > 0))
    at = np.searchsorted(ratio, ratio[shared], "left")
    return float((1 / (behind[at] / u[shared] + ahead[at] / v[shared])).sum())


def _weights(counts: bytes, n: int) -> np.ndarray:
    return 1 + np.log(np.frombuffer(counts, "<u4")) if counts else np.ones(n)


def likeness_of(a: np.ndarray, b: np.ndarray, counts_a: bytes = b"", counts_b: bytes = b"") -> float:
    """The greater of the plain and the weighted likeness."""
    plain = jaccard(a, b)
    if not counts_a and not counts_b:
        return plain
    return max(plain, probability_jaccard(a, _weights(counts_a, len(a)), b, _weights(counts_b, len(b))))


def _verify_work(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            counts = (batch.column(c).to_pylist() for c in (4, 5))
            like = np.array([likeness_of(*x) for x in zip(*sets, *counts, strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like >= least), pa.array(like)], names=["a", "b", "good", "like"])

    return work


def meet_of(likeness: float):
    """The operation of ``groups``' third round: pairs that the sizes, bitmaps and sketches allow."""
    least = likeness - ERRORS * float(np.sqrt(likeness * (1 - likeness) / REGISTERS))

    def arrays(items: list[dict]) -> tuple[np.ndarray, ...]:
        plain, weighted, bands = [], [], []
        for x in items:
            plain.append(np.frombuffer(x["sketch"], np.uint8))
            weighted.append(np.frombuffer(x["sketch_w"] or x["sketch"], np.uint8))
            bands.append(np.resize(np.array(x["keys"], np.int64), 2 * BANDS))  # one sketch for both: its bands twice
        flips = np.frombuffer(b"".join(x["parity"] for x in items), np.uint64).reshape(len(items), -1)
        numbers = (np.array([x[c] for x in items], np.int64) for c in ("component", "size"))
        return (*numbers, np.array([bool(x["sketch_w"]) for x in items]), flips, np.array(plain), np.array(weighted), np.array(bands))

    def agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return ((many == one).mean(axis=1) - 1 / 256) * 256 / 255 >= least

    def meet(key: int, one: list[dict], two: list[dict]) -> list[tuple[int, int]]:
        (ca, na, ra, fa, pa_, wa, ba), (cb, nb, rb, fb, pb, wb, bb) = arrays(one), arrays(two)
        found = []
        for i in range(len(one)):
            other = cb != ca[i]
            at = np.flatnonzero(other & (np.minimum(nb, na[i]) >= likeness * np.maximum(nb, na[i])))
            apart = np.bitwise_count(fb[at] ^ fa[i]).sum(axis=1, dtype=np.int64)
            at = at[apart * (1 + likeness) <= (nb[at] + na[i]) * (1 - likeness) + 1e-6]
            at = at[agree(pa_[i], pb[at])] if len(at) else at
            repeats = np.flatnonzero(other & (rb | ra[i]))
            if len(repeats):
                at = np.union1d(at, repeats[agree(wa[i], wb[repeats])])
            if len(at) and key in ba[i]:
                # once, in the first band that the two share; a plain band may also meet a weighted one, and a refined key is no band
                same = bb[at] == ba[i]
                at = at[(ba[i][np.argmax(same, axis=1)] == key) | ~same.any(axis=1)]
            found += [(i, int(j)) for j in at]
        return found

    return meet


def _classed(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """id, hash (of the text), copy_of, class_id, kept, n_links, like of every input row.

    Every row has a number of its own, so that texts under one doc_id are apart. ``kept``: the row's text and id are those
    that stand for the class (least id, then least text hash). ``n_links``: verified links of the text that were found, at least
    one in a class of several texts (links within a component that is known need no test); ``like``: the greatest likeness of them.
    """
    small_batches(docs.sparkSession)
    text = whole_text()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"))
    work = "id long, hash binary, size long, keys array<long>, sketch binary, sketch_w binary, parity binary"
    sketched = cut(texts.mapInArrow(_sketch_work, work).withColumn("row", F.monotonically_increasing_id()), "sketches")
    copies = sketched.groupBy("hash").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = cut(copies.where("n > 1").select("hash", "first"), "copies")
    own = sketched.select("row", "id", "hash").join(copies, "hash", "left")
    own = cut(own.select("row", "id", "hash", F.coalesce("first.row", "row").alias("node"), F.coalesce("first.id", "id").alias("copy_of")), "own")
    later = own.where("row != node").select("row")
    postings = sketched.where("size > 0").select("row", "keys").join(later, "row", "left_anti")
    postings = postings.select(F.col("row").alias("id"), F.explode("keys").alias("key"), F.lit(0).alias("place"))

    kept: list[DataFrame] = []

    def verify(pairs: DataFrame, ids: DataFrame) -> DataFrame:
        """Whether the shingle sets of pairs (a, b) are alike; the sets of ``ids`` are made once."""
        if not kept:
            nodes = cut(own.join(ids.select(F.col("id").alias("row")), "row", "left_semi").select("row", "id", "hash"), "nodes")
            some = texts.join(nodes, ["id", "hash"]).select("row", "text")
            sets = some.mapInArrow(_set_work, "id long, set binary, counts binary")
            if not nodes.select("id", "hash").join(own.where("row != node"), ["id", "hash"], "left_semi").isEmpty():
                sets = sets.dropDuplicates(["id"])  # rows that repeat id and text
            kept.append(cut(sets, "sets"))
        a, b = (kept[0].select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"), F.col("counts").alias(f"counts_{x}")) for x in "ab")
        both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b", "counts_a", "counts_b")
        return both.mapInArrow(_verify_work(likeness), "a long, b long, good boolean, like double")

    details = sketched.where("size > 0").select(F.col("row").alias("id"), "size", "sketch", "sketch_w", "keys", "parity")
    links, found = linked(postings, details, verify, meet_of(likeness), details.select("id", "keys"))
    ends = links.select(F.col("a").alias("node"), "b", "like").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("b"), "like"))
    counts = ends.groupBy("node").agg(F.countDistinct("b").alias("n_links"), F.max("like").alias("like"))
    found = found.withColumnRenamed("id", "node").join(own.where("row = node").select("node", "id", "hash"), "node")
    found = cut(found.join(counts, "node"), "found")
    stands = cut(found.groupBy("component").agg(F.min(F.struct("id", "hash")).alias("stands")), "stands")
    found = found.join(stands, "component").select("node", "stands", "n_links", "like")
    out = own.join(found, "node", "left")
    out = out.withColumn("stands", F.coalesce("stands", F.struct(F.col("copy_of").alias("id"), "hash")))
    return out.select(
        "id", "hash", "copy_of", F.col("stands.id").alias("class_id"), (F.col("stands") == F.struct("id", "hash")).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "like",
    )


def classes(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """id (doc_id, null as least number), copy_of (least id of equal texts), class_id (least id of the class): one row an input row."""
    return _classed(docs, likeness).select("id", "copy_of", "class_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of every class: that of the least doc_id, then of the least text hash, then of the least columns as JSON."""
    found = cut(_classed(docs).select("id", "hash", "kept"), "classed")
    often = cut(found.groupBy("id").count().where("count > 1").select("id"), "often")
    gone = cut(found.where("not kept").select("id").unionByName(often).distinct(), "gone")
    rows, names = numbered(docs)
    doc_id, text = (F.col(rows.columns[names.index(c)]) for c in ("doc_id", "text"))
    keyed = rows.withColumn("id", F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)))
    once = keyed.join(gone, "id", "left_anti").select(*rows.columns)
    # rows that share a doc_id are known by their texts
    hashed = F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    again = keyed.join(often, "id", "left_semi").withColumn("hash", hashed)
    row = F.struct(*rows.columns)
    again = again.join(found.where("kept").select("id", "hash").distinct(), ["id", "hash"], "left_semi")
    again = again.groupBy("id", "hash").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(again.select("row.*")).toDF(*names)


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, the links found of its text and the greatest likeness of them."""
    found = _classed(table(spark, sf_dir, "documents"))
    back = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("copy_of", "copy_of"), ("class_id", "class_id"))]
    return found.select(*back, "kept", "n_links", F.round("like", 6).alias("likeness"))
