"""Periodic runs of words by a scan of all lags.

The words of a text become numbers. For every lag q up to a ``min_exp``-th of the text, the array is compared with itself
shifted by q, many lags at a time; a stretch of t equal places at lag q is a run of t + q words with period q. A run must
have max(``min_len``, ``min_exp`` * q) words, so a stretch must cover at least that less q places: lags are first compared at
every s-th place, where a stretch that is long enough covers several places in a row, and only lags with so many equal places
in a row are compared in full and run-length coded. Nothing is lost by it, and the work on a text without runs grows with
n log n. A stretch whose period has a smaller one is no run of its own; it is told by its first words, and places inside it
are left out at later lags that are multiples of that smaller period.

Texts of over ``LONG`` code points are dealt to tasks by document and octave of lags (1, 2-3, 4-7, ...), which cost alike; the
runs of a document come together again by its row.

Defined results: words are stretches without the six ASCII white space characters; null and empty texts have no words and no
runs; repeated rows are documents of their own; doc_id may be null or repeated; other columns, whatever their names, are
carried; an empty table gives no rows; very long texts are one value of a row, as in the input.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches, table, whole_text

MIN_EXP, MIN_LEN = 4, 6
#: Code points from which a text is dealt by octaves of lags.
LONG = 1 << 20
#: Places compared at a time.
CELLS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: bytes split at the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    distinct = dict.fromkeys(words)
    code = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(code.__getitem__, words), np.uint32, len(words))


@functools.lru_cache(4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple(found + [q] if q > 1 else found)


def smallest_period(block: np.ndarray) -> int:
    """The smallest period that divides the length of ``block``, which is one period of a stretch of two or more."""
    q = len(block)
    for r in _prime_factors(q):
        while q % r == 0 and np.array_equal(block[: q - q // r], block[q // r : q]):
            q //= r
    return q


class _Known:
    """Stretches found so far, to leave out what lies inside one whose period divides the lag."""

    def __init__(self) -> None:
        self.rows: set[tuple[int, int, int]] = set()
        self.table: np.ndarray | None = None

    def add(self, start: int, end: int, period: int) -> None:
        if (start, end, period) not in self.rows:
            self.rows.add((start, end, period))
            self.table = None

    def outside(self, at: np.ndarray, q: int) -> bool:
        """True if a place of ``at`` and the one q behind it lie in no such stretch together."""
        if not self.rows:
            return True
        if self.table is None:
            self.table = np.array(sorted(self.rows), np.int64)
        rows = self.table[q % self.table[:, 2] == 0]
        if not len(rows):
            return True
        last = np.searchsorted(rows[:, 0], at, "right") - 1
        return bool(((last < 0) | (at + q >= rows[np.maximum(last, 0), 1])).any())


def runs_of(ids: np.ndarray, lo: int = 1, hi: int | None = None, min_exp: int = MIN_EXP, min_len: int = MIN_LEN) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with a period from ``lo`` up to ``hi``, in order of start and period."""
    n = len(ids)
    top = min(n // min_exp, n if hi is None else hi)
    found, known = [], _Known()
    padded = np.concatenate([ids, np.full(max(0, top) + 1, 0xFFFFFFFF, np.uint32)])
    q = max(1, lo)
    while q <= top:
        need = max(min_len - q, (min_exp - 1) * q, 1)
        stride = max(1, need // 5)
        places = -(-(n - q) // stride)
        lags = min(q, top - q + 1, max(1, CELLS // places))
        row = 4 if need // stride >= 4 else 2 if need // stride >= 2 else 1
        if places >= row:
            shifted = np.lib.stride_tricks.as_strided(padded[q:], (lags, places), (4, 4 * stride), writeable=False)
            same = shifted == padded[: n - q : stride]
            for step in (1, 2)[: row // 2]:
                same = same[:, :-step] & same[:, step:]
            for k in np.flatnonzero(same.any(axis=1)):
                _lag(ids, q + int(k), np.flatnonzero(same[k]) * stride, min_exp, min_len, known, found)
        q += lags
    return sorted(found, key=lambda r: (r[0], r[2]))


def _lag(ids: np.ndarray, q: int, hits: np.ndarray, min_exp: int, min_len: int, known: _Known, found: list) -> None:
    """One lag in full, if a hit lies outside the stretches that a smaller period explains."""
    # a run of period q shares less than q words with one of a period that divides q: none of its places lies in it
    if not known.outside(hits, q):
        return
    same = np.zeros(len(ids) - q + 2, np.int8)
    same[1:-1] = ids[q:] == ids[:-q]
    edge = np.flatnonzero(np.diff(same))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts + q >= max(min_len, min_exp * q)
    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        p = smallest_period(ids[start : start + q])
        known.add(start, end + q, p)
        if p == q:
            found.append((start, end + q - start, q))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    start, length, period = (np.array(x) for x in zip(*runs, strict=True))
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _listed(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass")


def _whole(min_exp: int, min_len: int):
    """text -> runs, collapsed, in front of the other columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                own = runs_of(word_ids(words), 1, None, min_exp, min_len) if len(words) >= min_len else []
                runs.append(_listed(own))
                texts.append(_text(collapsed(words, own)))
            yield _rows(batch, runs, texts)

    return work


def _rows(batch: pa.RecordBatch, runs: list, texts: list[str], drop: int = 1) -> pa.RecordBatch:
    own = [pa.array(runs, _RUNS), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays([*own, *batch.columns[drop:]], names=["__runs", "__collapsed", *batch.schema.names[drop:]])


def _octave(min_exp: int, min_len: int):
    """row, text, lag -> the runs with a period from lag up to the double of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, lag in zip(*batch.columns, strict=True):
                lo = lag.as_py()
                own = runs_of(word_ids(words_of(text.as_py())), lo, 2 * lo - 1, min_exp, min_len)
                for k in range(0, len(own), 1 << 16):
                    part = own[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(part), pa.int64()), pa.array(_listed(part), _RUNS.value_type)], names=["row", "run"])

    return work


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, runs -> runs, collapsed, in front of the other columns."""
    for batch in batches:
        runs, texts = [], []
        for text, own in zip(batch.column(0), batch.column(1), strict=True):
            listed = [(r["start"], r["length"], r["period"]) for r in own.as_py() or []]
            runs.append(_listed(listed))
            texts.append(_text(collapsed(words_of(text.as_py()), listed)))
        yield _rows(batch, runs, texts, 2)


def find_runs(docs: DataFrame, text: str = "text", min_exp: int = MIN_EXP, min_len: int = MIN_LEN, long: int = LONG) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in order of start and period) and ``collapsed``, the text without the repeats."""
    spark = docs.sparkSession
    small_batches(spark, 64)
    rows, names = numbered(docs)
    rows = rows.select(whole_text(rows.columns[names.index(text)]).alias("__text"), *rows.columns)
    kept = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[1:])
    shape = f"__runs {RUNS}, __collapsed string, {kept}"
    out = rows.where(F.length("__text") <= long).mapInArrow(_whole(min_exp, min_len), shape)
    large = cut(rows.where(F.length("__text") > long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    if not large.isEmpty():
        count = F.regexp_count("__text", F.lit(WORD))
        octaves = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(2), k).cast("long")), lambda q: q * min_exp <= count)
        lagged = large.select("__row", "__text", F.explode(octaves).alias("lag")).repartition(F.col("__row"), F.col("lag"))
        runs = lagged.mapInArrow(_octave(min_exp, min_len), "row long, run struct<start:bigint,length:bigint,period:bigint>")
        by = runs.groupBy("row").agg(F.collect_list(F.struct("run.start", "run.period", "run.length")).alias("listed"))
        sort = F.transform(F.array_sort("listed"), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
        both = large.join(by.select(F.col("row").alias("__row"), sort.alias("__listed")), "__row", "left")
        out = out.unionByName(both.select("__text", "__listed", *rows.columns[1:]).mapInArrow(_together, shape))
    return out.select(*[F.col(c).alias(n) for c, n in zip(rows.columns[1:], names, strict=True)], F.col("__runs").alias("runs"), F.col("__collapsed").alias("collapsed"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text with its tail made periodic in the tenth of documents whose id says so; others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # the lambda binds the words once
    return F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(words), edited)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, a tenth of them with a tail made periodic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    found = find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

