"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the least hash of its inner s-mers is that of its first or its last one. The
choice looks at the k-mer alone, so equal passages give equal anchors wherever they stand. The fingerprint keeps the 64
anchors of least hash with their positions, in hash order: 8 hex digits of hash and 6 of position (modulo 2**24) each. The
likeness of two fingerprints takes the least 64 anchors of their union, matches equal hashes by position (only matches at
the most frequent offset count) and gives their share: an estimate of the positional Jaccard likeness, exact up to 64
anchors.

Anchors are 12-mers with inner 5-mers; texts under 72 code points have 4-mers with inner 2-mers, those of 48 to 71 both;
a text of one to three code points is one anchor.

Defined results: null and empty texts have the empty fingerprint; equal fingerprints have likeness 1, an empty one has
likeness 0 to any other; repeated rows are documents of their own, in text order under one doc_id; a null doc_id comes
first in order; a single document is its own next one; an empty table gives no rows; other columns are ignored. Very long
texts take some tens of bytes of memory a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_key_order, small_batches, table, whole_text

KEEP = 64
LONG, SHORT = (12, 5), (4, 2)
LONG_FROM, SHORT_UNDER = 48, 72
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-mer."""
    n = len(points) - k + 1
    h = points[:n].copy()
    for j in range(1, k):
        h *= _ODD
        h += points[j : j + n]
    return _mixed(h)


def syncmers(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers."""
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = _grams(points, s)
    w = k - s + 1
    least, width = inner, 1
    while width < w:  # the minimum over w neighbours, by doubling
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    n = len(least)
    at = np.flatnonzero((least == inner[:n]) | (least == inner[w - 1 : w - 1 + n]))
    h = inner[at]
    for j in sorted({*range(s, w, s), w - 1}):  # s-mers that cover the k-mer
        h = h * _ODD + inner[at + j]
    return at, _mixed(h + np.uint64(k))


def anchors(text: str, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits, ascending) and positions of the ``keep`` least anchors."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    if n < SHORT[0]:
        found = [(np.zeros(1, np.int64), _grams(points, n))]
    else:
        found = [syncmers(points, *LONG)] if n >= LONG_FROM else []
        found += [syncmers(points, *SHORT)] if n < SHORT_UNDER else []
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * keep:  # the least few, with all that tie
        few = h <= np.partition(h, 4 * keep)[4 * keep]
        if len(np.unique(h[few])) >= keep:
            at, h = at[few], h[few]
    h, first = np.unique(h, return_index=True)
    return h[:keep], at[first[:keep]].astype(np.uint32) & np.uint32(0xFFFFFF)


def packed(found: tuple[np.ndarray, np.ndarray]) -> str:
    h, at = found
    out = np.empty((len(h), 7), np.uint8)
    out[:, :4] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = at.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return out.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keep: int = KEEP) -> float:
    (ha, pa_), (hb, pb) = a, b
    if len(ha) == len(hb) and np.array_equal(ha, hb) and np.array_equal(pa_, pb):
        return 1.0
    if not len(ha) or not len(hb):
        return 0.0
    every = np.union1d(ha, hb)[:keep]
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    use = both <= every[-1]
    if not use.any():
        return 0.0
    offsets = pa_[ia[use]].astype(np.int64) - pb[ib[use]].astype(np.int64)
    return float(np.unique(offsets, return_counts=True)[1].max() / len(every))


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, known = "", None
    for batch in batches:
        rows = []
        lead, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("lead", "doc_id", "text"))
        for is_lead, doc_id, text in zip(lead.to_pylist(), ids.to_pylist(), texts, strict=True):
            text = text.as_py()
            own = known if known is not None and text == before else anchors(text)
            if not is_lead:
                edited = edited_text(text, before)
                other = own if edited == text else anchors(edited)
                rows.append(
                    (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), packed(own), packed(other), likeness(own, other), likeness(own, known))
                )
            before, known = text, own
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the start of the next document."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole_text().alias("text"))
    ordered = in_key_order(rows, "doc_id", "text", carry=True).select("lead", "doc_id", "text")
    return ordered.mapInArrow(
        _work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
