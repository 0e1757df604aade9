"""Spelling variants: words one edit apart, found by Aho-Corasick automata of their halves.

One inserted, deleted or replaced code point leaves one half of a word as it is. Every word w of L code points gives two
patterns: its left half, which a near word of L or L + 1 code points must have at its front, and its right half, which that
word must have at its end. Patterns are dealt to shards by the hash of their segment and L; a shard builds one automaton of
its segments and scans the words that have a front or an end for it. A hit counts at the right offset and for a compatible
length only; then the rest of the two words is compared. Words of one length meet both ways, words one longer than a
pattern give the pair in both directions.

A segment that more than ``GROUP`` words of one length share is refined: the part where the edit must lie is cut in two,
and the pattern is the front and the end around either half, and so on down to a single place, where no more patterns than
letters can share a segment. No group is brought together in one task beyond that bound, and none is cut off.

A word's form is its near word of largest count (ties: the least in code-point order), where that count is at least
``RATIO`` times its own. Counts at least double along forms, so the last one is found by a few rounds of doubling.

Defined results: words are maximal runs of Basic Latin letters and U+00C0 to U+00FF, only A to Z are lower-cased; null and
empty texts have no words; repeated rows count again; a null doc_id reads as ``null``; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table, whole_text

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One in so many spellings of a document loses a code point.
MISSPELT = 97
#: Patterns that may share a segment before it is refined; above the number of letters, so that single places end it.
GROUP = 4096
#: Patterns of a shard, and words a task counts before it hands them on.
SHARD, COUNTED = 20_000, 200_000
LETTERS = re.compile(rb"[a-z\xc0-\xff]+")


def spellings(text: str) -> Counter:
    """Words of a text in Latin-1, which holds all letters; anything else parts words."""
    return Counter(LETTERS.findall(text.encode("latin-1", "replace").lower()))


def misspelt(doc_id: object, word: bytes, base: int) -> bytes:
    """The word as that document spells it; ``base`` is the CRC of ``<doc_id>:``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
    if h % MISSPELT:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(min_chars: int, plant: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in spellings(text.as_py()).items():
                    if plant:
                        word = misspelt(doc_id, word, base)
                    if len(word) >= min_chars:
                        total[word] = total.get(word, 0) + n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return work


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, plant: bool = False) -> DataFrame:
    """word, n of every word of enough code points and occurrences; with ``plant``, as the documents misspell them."""
    small_batches(docs.sparkSession, 256)
    counted = docs.select(F.col("doc_id").cast("string"), whole_text().alias("text")).mapInArrow(_count(min_chars, plant), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(a: str, b: str) -> Column:
    """Holes [a, b) -> the two that its halves are: the edit is in the one or the other."""
    mid = F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    return F.array(F.struct(mid.alias("a"), F.col(b).alias("b")), F.struct(F.col(a).alias("a"), mid.alias("b")))


def _refined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hole", F.explode(_halves("a", "b"))).withColumns({"a": F.col("hole.a"), "b": F.col("hole.b")}).drop("hole")


def _keyed(rows: DataFrame) -> DataFrame:
    """word, n, size (of the pattern), a, b -> with key: the pattern's size and hole, the front before it and the end behind it."""
    behind = F.col("size") - F.col("b")
    front, end = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - behind + 1, behind)
    return rows.withColumn("key", F.xxhash64("size", "a", "b", front, end))


def _routed(words: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Patterns, and the words to be scanned, with the key of every segment they have or can hit."""
    base = words.withColumns({"size": F.length("word"), "a": F.lit(0)})
    patterns = _keyed(_refined(base.withColumn("b", F.col("size"))))
    lengths = F.array(F.col("size"), F.col("size") - 1)
    scanned = _keyed(_refined(base.withColumn("size", F.explode(lengths)).where("size > 1").withColumn("b", F.col("size"))))
    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        single = F.max(F.col("b") - F.col("a")) > 1
        hot = cut(patterns.groupBy("key").agg(F.count("*").alias("held"), single.alias("wide")).where((F.col("held") > group) & F.col("wide")).select("key"), "hot-segments")
        if hot.isEmpty():
            done.append((patterns, scanned))
            break
        done.append((patterns.join(hot, "key", "left_anti"), scanned.join(hot, "key", "left_anti")))
        patterns, scanned = (cut(_keyed(_refined(x.join(hot, "key", "left_semi"))), "refined") for x in (patterns, scanned))
    patterns, scanned = done[0]
    for more, also in done[1:]:
        patterns, scanned = patterns.unionByName(more), scanned.unionByName(also)
    return patterns, scanned


class Shard:
    """An automaton of the segments of some patterns."""

    def __init__(self) -> None:
        self.groups: dict[tuple[int, int, int, str, str], list[tuple[str, int]]] = {}
        self.automaton: ahocorasick.Automaton | None = None
        self.rests: dict[tuple, np.ndarray] = {}

    def add(self, word: str, n: int, a: int, b: int) -> None:
        self.groups.setdefault((len(word), a, b, word[:a], word[b:]), []).append((word, n))

    def close(self) -> None:
        """Each group hangs on its front, or on its end where it has no front; the other one is compared at a hit."""
        at: dict[str, tuple[list, list]] = {}
        for key in self.groups:
            front, end = key[3:]
            at.setdefault(front or end, ([], []))[0 if front else 1].append(key)
        self.automaton = ahocorasick.Automaton()
        for segment, keys in at.items():
            self.automaton.add_word(segment, (len(segment), *keys))
        self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The patterns of the word's length, or one shorter, that are one edit from it."""
        size = len(word)
        for last, (length, fronts, ends) in self.automaton.iter(word):
            # offsets: a front begins the word, an end closes it
            for key in (fronts if last == length - 1 else []) + (ends if last == size - 1 else []):
                if size - key[0] in (0, 1) and (not key[4] or word.endswith(key[4])):
                    yield from self.verified(word, key)

    def verified(self, word: str, key: tuple[int, int, int, str, str]) -> Iterator[tuple[str, int]]:
        size, a, b, _, _ = key
        held, rest = self.groups[key], word[a : len(word) - (size - b)]
        if len(held) < 24:
            longer = len(word) > size
            for other, n in held:
                if _one_edit(other[a:b], rest, longer):
                    yield other, n
            return
        if key not in self.rests:
            self.rests[key] = np.array([other[a:b] for other, _ in held], f"<U{b - a}").view(np.uint32).reshape(len(held), b - a)
        theirs, own = self.rests[key], np.array([rest], f"<U{len(rest)}").view(np.uint32)
        if len(word) == size:
            hit = (theirs != own).sum(axis=1) == 1
        else:
            before = np.logical_and.accumulate(theirs == own[:-1], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate((theirs == own[1:])[:, ::-1], axis=1).sum(axis=1)
            hit = before + behind >= b - a
        for k in np.flatnonzero(hit).tolist():
            yield held[k]


def _one_edit(theirs: str, own: str, longer: bool) -> bool:
    """Exactly one replaced code point, or one more in ``own``."""
    k, n = 0, len(theirs)
    while k < n and theirs[k] == own[k]:
        k += 1
    return theirs[k:] == own[k + 1 :] if longer else k < n and theirs[k + 1 :] == own[k + 1 :]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, patterns first -> pairs."""
    shard, number = Shard(), None
    found: list[tuple[str, int, str, int]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "near", "near_n"])

    for batch in batches:
        for s, scanned, word, n, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != number:
                shard, number = Shard(), s
            if not scanned:
                shard.add(word, n, a, b)
                continue
            if not shard.groups:
                continue
            if shard.automaton is None:
                shard.close()
            for other, k in shard.near(word):
                found.append((word, n, other, k))
                if len(other) < len(word):
                    found.append((other, k, word, n))
            if len(found) > 10_000:
                yield out()
    if found:
        yield out()


def near_pairs(words: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """word, n, near, near_n: every word (of ``words``: word, n, each word once) with every other that is one edit away."""
    spark = words.sparkSession
    small_batches(spark, 4096)
    words = cut(words.select("word", "n"), "words")
    patterns, scanned = _routed(words, group)
    parts = partitions(spark)
    shards = max(parts, -(-2 * words.count() // shard))
    of = F.pmod("key", F.lit(shards)).alias("shard")
    # a word that several keys lead to one shard is scanned there once
    rows = patterns.select(of, F.lit(False).alias("scanned"), "word", "n", "a", "b").unionByName(
        scanned.select(of, F.lit(True).alias("scanned"), "word", "n", F.lit(0).alias("a"), F.lit(0).alias("b"))
    )
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "scanned", "word")
    pairs = dealt.mapInArrow(_scan, "word string, n long, near string, near_n long")
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, form (never a cycle) -> word, root: the last form, by doubling the steps until none has one more."""
    done: list[DataFrame] = []
    steps = cut(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """word, n -> word, form, root, n, n_near, form_n."""
    words = cut(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    by = near_pairs(words, group, shard).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.n") >= ratio * F.col("n")
    both = words.join(by, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).cast("long").alias("form_n"),
    )
    both = cut(both, "variants")
    last = roots(both.where("form is not null"))
    return both.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, one in 97 spellings of a document misspelt, with their forms."""
    return variants(vocabulary(table(spark, sf_dir, "documents"), plant=True))
