"""Token ids in a binary file format: Simple-8b words.

A 64-bit word holds a selector (4 bits, on top) and as many ids as fit with its width: 120 zeros (selector 1), then 60 ids
of 1 bit (2) down to one id of 60 bits (15). Selector 0 is the escape: it holds a count, and that many whole 64-bit words
follow with ids of over 60 bits, which no selector 0 can be mistaken for.

A segment is one row of the file: whole documents, at least one, closed at 64 Ki ids. Its payload is
``S8B1 | documents | ids | words | blocks | doc ids | ids before each document | words before and ids before each block |
the words`` as little-endian 64-bit numbers behind the mark; a block is 512 words (a run of escaped ids is never split), so that a reader can
decode any block by itself and each selector of it at once. Segments are Parquet rows (part, seq, before, n_ids, payload)
in the shared folder, part files in ascending doc_id order: Spark commits them, so lost executors leave no half file.

Defined results: a null or empty text is the end id alone; repeated doc_ids are documents of their own, in order of their
ids; a null doc_id comes first in order; a very long document is one segment; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import by_part, cut, in_key_order, small_batches, table, whole_text

#: (ids, bits) of selectors 1 to 15, fixed by the coding.
LAYOUT = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([0] + [n for n, _ in LAYOUT], np.int64)
MARK = b"S8B1\0\0\0\0"
SEGMENT_IDS = 1 << 16
BLOCK_WORDS = 512
END_ID = 1
#: Words kept, and their code points in all: long words fill a generation sooner.
CACHE_WORDS, CACHE_CHARS = 500_000, 16_000_000
NULL_ID = -(2**63)
#: Letters and signs whose lower case and splitting is the same in any Unicode version; a text of others goes to the library whole.
OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")  # also read by Arrow
#: Second bytes of these letters that the byte alphabet moves up.
LATE = (0x9F, 0xA0, 0xAD)
PRE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of ids that each of them gives (0 for an escape, 1 for a word that it announces)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    large = ids >> np.uint64(60) != 0
    if not large.any():
        return _packed(ids)
    words, counts = [], []
    edge = np.flatnonzero(np.diff(large)) + 1
    for run in np.split(np.arange(len(ids)), edge):
        if large[run[0]]:
            words += [np.array([len(run)], np.uint64), ids[run]]
            counts += [np.zeros(1, np.int64), np.ones(len(run), np.int64)]
        else:
            w, c = _packed(ids[run])
            words.append(w)
            counts.append(c)
    return np.concatenate(words), np.concatenate(counts)


def _packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    best = np.full(n, 15, np.int8)
    small = ids.astype(np.int32) if n and ids.max() < 1 << 31 else ids
    over = np.zeros(n + 1, np.int32)
    for selector in range(14, 0, -1):
        count, bits = LAYOUT[selector - 1]
        if count > n:
            break
        if bits < 31 or small is ids:
            np.cumsum(small >= small.dtype.type(1 << bits), dtype=np.int32, out=over[1:])
        fits = over[count:] == over[: n + 1 - count]
        if not fits.any():
            break  # more ids of fewer bits fit nowhere either
        np.copyto(best[: n + 1 - count], selector, where=fits)
    jump, chosen_at, path, i = COUNTS.tolist(), best.tobytes(), [], 0
    add = path.append
    while i < n:
        add(i)
        i += jump[chosen_at[i]]
    at = np.array(path, np.int64)
    chosen = best[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, bits = LAYOUT[selector - 1]
        if bits:
            some = np.flatnonzero(chosen == selector)
            values = ids[at[some][:, None] + np.arange(count)]
            words[some] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, COUNTS[chosen]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole words, all words of a selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selectors == 0):
        if not raw[at]:
            raw[at + 1 : at + 1 + int(words[at])] = True
    counts[raw] = 1
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[start[raw]] = words[raw]
    selectors[raw] = 0
    for selector in np.unique(selectors):
        count, bits = LAYOUT[selector - 1] if selector else (0, 0)
        if bits:
            some = np.flatnonzero(selectors == selector)
            values = words[some][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[start[some][:, None] + np.arange(count)] = values & np.uint64((1 << bits) - 1)
    return out


def segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, counts = pack(ids)
    before = np.cumsum(counts) - counts
    # a block starts at a selector word, never at an escaped id
    free = np.ones(len(words), bool)
    for at in np.flatnonzero(counts == 0):
        free[at + 1 : at + 1 + int(words[at])] = False
    starts, at = [], 0
    while at < len(words):
        while at < len(words) and not free[at]:
            at += 1
        if at < len(words):
            starts.append(at)
        at += BLOCK_WORDS
    starts = np.array(starts, np.int64)
    doc_start = np.cumsum(np.array(lengths, np.int64)) - np.array(lengths, np.int64)
    blocks = np.stack([starts, before[starts]], axis=1) if len(starts) else np.empty((0, 2), np.int64)
    head = np.array([len(doc_ids), len(ids), len(words), len(starts)], np.int64)
    parts = [head, np.array(doc_ids, np.int64), doc_start, blocks.ravel(), words]
    return MARK + b"".join(np.ascontiguousarray(p).astype(p.dtype.newbyteorder("<")).tobytes() for p in parts)


class Segment:
    """Reads a payload: documents, and ids of any block or range."""

    def __init__(self, payload: bytes):
        if payload[:8] != MARK:
            raise ValueError("not a token segment")
        n_docs, self.n_ids, n_words, n_blocks = np.frombuffer(payload, "<i8", 4, 8).tolist()
        at = 40
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.doc_start = np.frombuffer(payload, "<i8", n_docs, at + 8 * n_docs)
        at += 16 * n_docs
        self.blocks = np.frombuffer(payload, "<i8", 2 * n_blocks, at).reshape(-1, 2)
        self.words = np.frombuffer(payload, "<u8", n_words, at + 16 * n_blocks)

    def block(self, k: int) -> np.ndarray:
        upto = self.blocks[k + 1, 0] if k + 1 < len(self.blocks) else len(self.words)
        return unpack(self.words[self.blocks[k, 0] : upto])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        stop = self.n_ids if stop is None else stop
        if stop <= start:
            return np.empty(0, np.uint64)
        first = int(np.searchsorted(self.blocks[:, 1], start, "right")) - 1
        last = int(np.searchsorted(self.blocks[:, 1], stop, "left"))
        upto = self.blocks[last, 0] if last < len(self.blocks) else len(self.words)
        base = int(self.blocks[first, 1])
        return unpack(self.words[self.blocks[first, 0] : upto])[start - base : stop - base]


class WordIds:
    """Ids of texts as the library gives them, by lower-cased white-space words whose ids are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        # the same model for words that are normal and split already
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = byte_alphabet()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, words: set[str]) -> None:
        """The words' ids, from one call: every pre-token's last id is a word end."""
        self.held += sum(map(len, words))
        plain = []
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                if "'" in w or "<|" in w:
                    ids = self.whole(w)
                else:
                    plain.append(w)
                    continue
            self.known[w] = ids
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            split = [PRE.findall(w) for w in some]
            text = " ".join(chain.from_iterable(split))
            if not text.isascii():
                text = text.encode().decode("latin-1")  # the byte alphabet is Latin-1 but for these
                for c in LATE:
                    text = text.replace(chr(c), self.alphabet[c])
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            place = np.cumsum([len(x) for x in split]) - 1
            if len(stop) != place[-1] + 1:
                raise ValueError("the library split words in an unexpected way")
            cuts = (4 * stop[place]).tolist()
            raw, at = ids.tobytes(), 0
            for w, to in zip(some, cuts, strict=True):
                self.known[w] = raw[at:to]
                at = to

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of every text, and the end id behind each.

        Words are split and numbered by Arrow, so that each distinct word of the batch is looked up once.
        """
        if len(self.known) > CACHE_WORDS or self.held > CACHE_CHARS:
            self.older, self.known, self.held = self.known, {"": b""}, 0
        plain = pc.invert(pc.match_substring_regex(texts, OTHER.pattern))
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(plain)))
        coded = words.flatten().dictionary_encode()
        # no word holds a space: one string to Python instead of each word
        listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        distinct = pc.binary_join(listed, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        new = set(filterfalse(self.known.__contains__, distinct))
        if new:
            self.learn(new)
        found = list(map(self.known.__getitem__, distinct))
        blob = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[code]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = blob[np.repeat(starts[code] - ends[:-1], lengths) + np.arange(ends[-1])] if len(code) else blob
        edges = ends[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(words) else []
        tail = np.array([end_id], np.uint32)
        out, k = [], 0
        for text, simple in zip(texts, plain.to_pylist(), strict=True):
            if simple:
                own = ids[edges[k] : edges[k + 1]]
                k += 1
            else:
                own = np.frombuffer(self.whole(text.as_py()), np.uint32)
            out.append(np.concatenate([own, tail]))
        return out


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(path: str | None, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path or default_path())
        gc.disable()  # nothing here makes cycles
        try:
            for batch in batches:
                ids = [_short(x) for x in own.encode(batch.column(1), end_id)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        finally:
            gc.enable()

    return work


def _short(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, behind a mark of the width."""
    return b"\2" + ids.astype(np.uint16).tobytes() if ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[int] = []
    ids: list[np.ndarray] = []
    part = seq = before = held = 0

    def close() -> pa.RecordBatch:
        nonlocal docs, ids, seq, before, held
        payload = segment(docs, [len(x) for x in ids], np.concatenate(ids))
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())],
            names=["part", "seq", "before", "n_ids", "payload"],
        )
        docs, ids, seq, before, held = [], [], seq + 1, before + held, 0
        return row

    for batch in batches:
        for p, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if docs and (p != part or held >= SEGMENT_IDS):
                yield close()
            if p != part:
                part, seq, before = p, 0, 0
            docs.append(NULL_ID if doc_id is None else doc_id)
            ids.append(_long(raw))
            held += len(ids[-1])
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token file of all documents and returns it as read back: part, seq, before, n_ids, payload."""
    small_batches(docs.sparkSession, 512)
    encoded = docs.select("doc_id", whole_text().alias("text")).mapInArrow(_encode(path, end_id), "doc_id long, ids binary")
    # the order is dealt by the ids of the table itself, which are read alone for it
    ordered = in_key_order(encoded, "doc_id", "ids", keys=docs.select("doc_id")).select("part", "doc_id", "ids")
    return cut(ordered.mapInArrow(_write, "part int, seq long, before long, n_ids long, payload binary"), "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seg = Segment(raw.as_py())
            ids = seg.ids().astype("<u4")
            edges = [*seg.doc_start.tolist(), len(ids)]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if d == NULL_ID else d for d in seg.doc_ids.tolist()], pa.int64()),
                    pa.array(base + seg.doc_start, pa.int64()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(file: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the file."""
    # one number a part file on the driver
    sums = sorted((r["part"], r["n"]) for r in file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n
    start = by_part(base) if base else F.lit(0)
    rows = file.select((start.cast("long") + F.col("before")).alias("base"), "payload")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
