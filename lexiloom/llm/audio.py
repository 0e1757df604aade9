"""Chroma fingerprints of audio columns.

A recording (WAV bytes) becomes frames of twelve pitch classes. Sixteen box filters, evaluated on the integral image of the
frames, compare areas over up to twelve frames; each is quantised to two bits (Gray code), which makes a packed 32-bit item
for every frame. Two recordings are aligned by the histogram of offsets between equal items; of the best offsets, the one
with the least bit errors counts.

Classes: recordings of equal fingerprints are one class from the start. The others meet by keys of four items nine frames apart:
of every item the signs of twelve filters, the bits that noise turns least (the outer thresholds' bits turn four times as often).
Six tables of keys leave out other filters. An eighth of the keys is met first, so that near copies are one component
before the others are gathered. A bucket is tested as in ``groups.linked``, and a link is an alignment over at
least half of the shorter recording with at most a quarter of the bits wrong. In the third round members are compared bit by
bit at the offset that their places in the bucket give.

Defined results: null, empty or unreadable audio, and audio shorter than the filters, has no items and is a class of its
own; silence gives equal items; every row is a recording, also where ids are null or repeated (a null id comes last); stereo is mixed down, 8 and 16 bits are read; long
recordings are worked off in blocks of frames; an empty table gives no rows; other columns are ignored. Runs of one item
count once in the histogram. Keys of four equal items (silence, a held tone) are none unless the recording has no others.
Recordings of under 28 items are in a class with equal fingerprints only.
"""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .groups import linked, starred
from .minhash import mixed

FRAME_S, LOW_HZ, HIGH_HZ = 0.256, 55.0, 1760.0
CLASSES = 12
WIDTH = 12
#: (kind, first pitch class, pitch classes, frames). Kinds: halves by pitch, halves by time, diagonal quarters, middle third
#: by pitch, middle third by time.
FILTERS = [
    (0, 0, 12, 3), (0, 0, 6, 6), (0, 6, 6, 6), (0, 3, 6, 9), (1, 0, 12, 4), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8),
    (2, 0, 12, 8), (2, 2, 8, 12), (2, 4, 8, 6), (3, 0, 12, 6), (3, 0, 9, 12), (3, 3, 9, 4), (4, 0, 6, 9), (4, 6, 6, 12),
]
STEP = 0.35  # outer thresholds of the quantiser; the middle one is 0
WRONG, OVERLAP = 0.25, 0.5
BLOCK_FRAMES = 4096
#: Equal pairs of items whose offsets are counted at a time.
PAIRS = 1 << 20
#: One key in so many is met ahead of the others.
EARLY = 8
#: Items of a key by their distance from its place.
APART = (0, 9, 18, 27)
#: Filters whose signs a table's keys leave out, by item: four of the sixteen, dealt anew for every table.
LEFT_OUT = [[[(5 * t + 7 * i + 4 * j + (t * i * j) % 4) % 16 for j in range(4)] for i in range(len(APART))] for t in range(6)]
MASKS = np.array([[0xAAAAAAAA & ~sum(2 << (2 * f) for f in out) for out in table] for table in LEFT_OUT], np.uint32)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1, and the rate; none of what can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0, np.float32), 0
    if width not in (1, 2) or not rate:
        return np.empty(0, np.float32), 0
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768 if width == 2 else (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    return x.reshape(-1, channels).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@functools.lru_cache(8)
def _pitch(rate: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Frame length, window, and the matrix from spectrum to pitch classes."""
    size = 1 << max(6, round(np.log2(rate * FRAME_S)))
    hz = np.fft.rfftfreq(size, 1 / rate)
    to = np.zeros((len(hz), CLASSES), np.float32)
    for i, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            to[i, round(CLASSES * np.log2(f / 440.0)) % CLASSES] = 1
    return size, np.hanning(size).astype(np.float32), to


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch-class energies, smoothed over five frames, each of length 1."""
    if not rate:
        return np.empty((0, CLASSES), np.float32)
    size, window, to = _pitch(rate)
    if len(samples) < size:
        return np.empty((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[:: size // 3]
    out = np.concatenate([np.abs(np.fft.rfft(frames[i : i + BLOCK_FRAMES] * window, axis=1)).astype(np.float32) ** 2 @ to for i in range(0, len(frames), BLOCK_FRAMES)])
    if len(out) >= 5:
        out = sum(w * out[i : len(out) - 4 + i] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0.01, out / np.maximum(length, 1e-9), 0).astype(np.float32)


def items(frames: np.ndarray) -> np.ndarray:
    """The packed fingerprint."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.astype(np.float64).cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        q = p + h
        if kind == 0:
            a, b = area(0, w, p, p + h // 2), area(0, w, p + h // 2, q)
        elif kind == 1:
            a, b = area(0, w // 2, p, q), area(w // 2, w, p, q)
        elif kind == 2:
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, q)
            b = area(0, w // 2, p + h // 2, q) + area(w // 2, w, p, p + h // 2)
        elif kind == 3:
            a = area(0, w, p + h // 3, p + 2 * h // 3)
            b = (area(0, w, p, q) - a) / 2
        else:
            a = area(w // 3, 2 * w // 3, p, q)
            b = (area(0, w, p, q) - a) / 2
        value = np.round(np.log((1 + a) / (1 + b)), 6)
        level = (value >= -STEP).astype(np.uint32) + (value >= 0) + (value >= STEP)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    return items(chroma(*read_wav(data)))


def align(a: np.ndarray, b: np.ndarray, tries: int = 5) -> tuple[int, int, float] | None:
    """Offset (place in a less place in b), equal items at it, share of wrong bits; none without an equal item.

    Only offsets of enough overlap count. Of the ``tries`` most voted ones that of the least wrong bits is taken; where it has too
    many, the others follow, and the first that has few enough is taken, so a link is missed at no voted offset.
    """
    if not len(a) or not len(b):
        return None
    ia, ib = (np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in (a, b))
    order = np.argsort(b[ib], kind="stable")
    ib = ib[order]
    low, high = np.searchsorted(b[ib], a[ia], "left"), np.searchsorted(b[ib], a[ia], "right")
    n = high - low
    if not n.any():
        return None
    # votes by offset, from some equal pairs at a time
    count, ends = np.zeros(len(a) + len(b), np.int64), np.cumsum(n)
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + PAIRS, "right")))
        some = n[begin:end]
        first = np.repeat(low[begin:end] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        np.add(count, np.bincount(np.repeat(ia[begin:end], some) - ib[first] + len(b), minlength=len(count)), out=count)
        begin = end
    offsets = np.flatnonzero(count) - len(b)
    votes = count[offsets + len(b)]
    overlap = np.minimum(len(a) - np.maximum(offsets, 0), len(b) - np.maximum(-offsets, 0))
    enough = overlap >= OVERLAP * min(len(a), len(b))
    offsets, votes, overlap = offsets[enough], votes[enough], overlap[enough]
    order = np.lexsort((np.abs(offsets), -votes))
    best = None
    for tried, k in enumerate(order):
        at, m = int(offsets[k]), int(overlap[k])
        wrong = wrong_at(a, b, at, m)
        if best is None or wrong < best[2]:
            best = (at, int(votes[k]), wrong)
        if tried + 1 >= tries and best[2] <= WRONG:
            break
    return best


def wrong_at(a: np.ndarray, b: np.ndarray, at: int, m: int) -> float:
    """The share of wrong bits of the m items that overlap at an offset."""
    x, y = a[max(0, at) :][:m], b[max(0, -at) :][:m]
    return float(np.bitwise_count(x ^ y).sum() / (32 * m))


def keys_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a fingerprint and the first place of each."""
    n = len(p) - APART[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    four = np.stack([p[d : d + n] for d in APART])
    places = np.flatnonzero((four[1:] != four[:1]).any(axis=0))
    places = places if len(places) else np.arange(n)
    four = four[:, places].astype(np.uint64)
    out = []
    for t, masks in enumerate(MASKS.astype(np.uint64)):
        h = np.full(len(places), t + 1, np.uint64)
        for x, mask in zip(four, masks, strict=True):
            h = mixed((h << np.uint64(32)) ^ (h >> np.uint64(32)) ^ (x & mask))
        out.append(h.view(np.int64))
    keys, first = np.unique(np.concatenate(out), return_index=True)
    return keys, np.tile(places, len(MASKS))[first]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary())], names=["id", "print"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """id, print (32-bit items, little-endian) of recordings (id, audio)."""
    small_batches(recordings.sparkSession, 64)
    return recordings.select("id", "audio").mapInArrow(_prints, "id long, print binary")


def _index(share: int = 1):
    """Postings key, id, place, component of rows id, print, component: of all keys, or of one in ``share`` (of each recording the same)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys_of(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            if share > 1:
                found = [(k[own], p[own]) for k, p in found for own in [k % share == 0]]
            n = [len(k) for k, _ in found]
            if sum(n):
                ids, of = (np.repeat(batch.column(c).to_numpy(), n) for c in (0, 2))
                keys, places = (np.concatenate([x[c] for x in found]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(of, pa.int64())], names=["key", "id", "place", "component"])

    return work


def meet(key: int, one: list[dict], two: list[dict]) -> list[tuple[int, int]]:
    """Pairs of two blocks of a bucket with few enough wrong bits at the offset of their places."""
    found = []
    a, b = ([np.frombuffer(x["print"], "<u4") for x in rows] for rows in (one, two))
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            if x["component"] != y["component"]:
                at = x["place"] - y["place"]
                m = min(len(a[i]) - max(at, 0), len(b[j]) - max(-at, 0))
                if m >= OVERLAP * min(len(a[i]), len(b[j])) and wrong_at(a[i], b[j], at, m) <= WRONG:
                    found.append((i, j))
    return found


def _align_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = ([np.frombuffer(x, "<u4") for x in batch.column(c).to_pylist()] for c in (2, 3))
        got = [align(a, b) for a, b in zip(*sides, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([g is not None and g[2] <= WRONG for g in got], pa.bool_()),
                pa.array([1 - g[2] if g else 0.0 for g in got], pa.float64()), pa.array([g and g[0] for g in got], pa.int64()), pa.array([g and g[2] for g in got], pa.float64()),
            ],
            names=["a", "b", "good", "like", "shift", "wrong"],
        )


def aligned(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """a, b, good, like (share of right bits), shift, wrong of pairs (a, b) of recordings; prints: id, print."""
    a, b = (prints.select(F.col("id").alias(x), F.col("print").alias(f"print_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "print_a", "print_b")
    return both.mapInArrow(_align_work, "a long, b long, good boolean, like double, shift long, wrong double")


def classes(recordings: DataFrame) -> DataFrame:
    """id, print, copy_of (least id of equal fingerprints), class_id (least id of the class), row, class_row: one row an input row.

    Rows are numbered, so that recordings under one id or without id are apart; ``class_row`` is the row that stands for the class.
    """
    prints = cut(fingerprints(recordings).withColumn("row", F.monotonically_increasing_id()), "prints")
    digest = F.struct(F.xxhash64("print"), F.sha2("print", 256))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = prints.where(F.length("print") > 0).groupBy(digest.alias("same")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1").select("same", "first"), "copies")
    own = prints.withColumn("same", digest).join(first, "same", "left")
    own = cut(own.select("row", "id", "print", F.coalesce("first", order).alias("first")), "own")
    single = own.where("row = first.row").select(F.col("row").alias("id"), "print")
    posting = "key long, id long, place long, component long"
    early = single.withColumn("component", F.col("id")).mapInArrow(_index(EARLY), posting)
    links, found = starred(early, lambda pairs, ids: aligned(pairs, single))
    labelled = single.join(found, "id", "left").select("id", "print", F.coalesce("component", "id").alias("component"))
    postings = labelled.mapInArrow(_index(), posting)
    _, found = linked(postings, single, lambda pairs, ids: aligned(pairs, single), meet, known=(links, found))
    named = found.join(own.where("row = first.row").select(F.col("row").alias("id"), "first"), "id")
    stands = cut(named.groupBy("component").agg(F.min("first").alias("stands")), "stands")
    of = named.join(stands, "component").select(F.col("id").alias("node"), "stands")
    out = own.join(of, own["first.row"] == of["node"], "left").withColumn("stands", F.coalesce("stands", "first"))
    return out.select("id", "print", F.col("first.id").alias("copy_of"), F.col("stands.id").alias("class_id"), "row", F.col("stands.row").alias("class_row"))


# ---- recordings for the query: the synthetic tables hold no audio, so each vector is played as a melody

RATE, NOTE = 4000, 500


def render(vectors: DataFrame) -> DataFrame:
    """id, audio: every component of a vector is a note of an eighth second, its pitch from the component's size."""
    small_batches(vectors.sparkSession, 64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.array([x or 0.0 for x in v or []])
                scale = np.sqrt((v**2).mean()) if len(v) and v.any() else 1.0
                level = np.clip(np.round(v / scale * 1.5), -5, 5)
                hz = 440.0 * 2 ** (level * 2 / 12)
                phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, NOTE))
                out.append(write_wav(0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase), RATE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "audio"])

    return vectors.select("id", "vector").mapInArrow(work, "id long, audio binary")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's fingerprint, class, and alignment with the class's first recording."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = cut(classes(render(vectors)), "classes")
    pairs = found.where("row != class_row").select(F.col("row").alias("a"), F.col("class_row").alias("b"))
    how = aligned(pairs, found.select(F.col("row").alias("id"), "print")).select(F.col("a").alias("row"), "shift", "wrong")
    return found.join(how, "row", "left").select(
        F.col("id").alias("vec_id"), (F.length("print") / 4).cast("long").alias("n_items"), F.crc32("print").alias("items_crc32"),
        "copy_of", "class_id", F.coalesce("shift", F.lit(0)).alias("shift"), F.coalesce("wrong", F.when(F.col("row") == F.col("class_row"), 0.0)).alias("bit_error"),
    )
