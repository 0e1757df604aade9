"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

Encoding. For every prefix of a word the transducer holds the last token of that prefix's encoding: the one token that ends
there and may stand behind the last token of the prefix before it. Two tokens may stand side by side when no merge across
their border comes before both are complete. A token yet to come starts less than ``lookahead`` symbols before the end of
what was read, where ``lookahead`` is the greatest token length that the merge list makes; so once the chains of last
tokens from all those places have joined, everything before the joint is stable and is emitted. Memory is the stretch
behind the last joint, whatever the length of the input.

Decoding. Ids become bytes, bytes become text through an incremental UTF-8 decoder that keeps at most three open bytes.
The vocabulary file names no decoder, so its library joins the pieces by one space; ``decode_pieces`` does that,
``decode_text`` restores plain text from the byte alphabet and the word ends.

Text is normalised as the file says: NFC, white space to spaces, lower case code point by code point; special tokens are
found in the raw text first. Character tables differ by their year, so a stretch that holds a code point unknown to Python's
(or of a script that came after the library's normaliser) is normalised and split by the library itself. Nothing in these rules reaches over a space, tab or line break, so a text is worked off in
stretches that end at one; a cache of bounded size keeps the results of short pre-tokens.

Defined results: null and empty texts give no ids, and digests of the empty string; ids of rows repeated are repeated;
very long texts and words need memory for their row and the stretch since the last joint; an empty table gives no rows;
other columns are carried or ignored as the caller selects them.
"""

from __future__ import annotations

import codecs
import functools
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: The Unicode white space property, fixed.
SPACE = "\u0009-\u000d \u0085   -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
RUN = regex.compile(f"[{SPACE}]+")
BLANK = regex.compile(r"[ \t\n\r]")
#: Fixed: the first and last code point of a script whose compositions the library's normaliser does not know.
LATER = (0x11900, 0x1195F)
#: Symbols that end a word are the plain symbol moved up by this; the byte alphabet lies far below.
ENDS = 0x10000
CACHE_WORDS = 150_000
CACHE_PAIRS = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free one from U+0100."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_OF = {c: b for b, c in byte_alphabet().items()}


class Merges:
    """What the merge list says: tokens by their symbols, spines of every token, the lookahead."""

    @functools.cached_property
    def rules(self):
        """The library's normaliser and splitter of the file, loaded where a text needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        self.end = end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The bytes of every id's piece.
        self.piece = {i: s.encode() for s, i in (model["vocab"] | self.special).items()}
        self.special_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

        def symbols(s: str) -> str:
            if end and s.endswith(end) and len(s) > len(end):
                s = s[: -len(end)]
                return s[:-1] + chr(ord(s[-1]) + ENDS)
            return s

        self.ids = {symbols(s): i for s, i in model["vocab"].items()}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j = self.ids[a], self.ids[b]
            self.rank[i << 20 | j] = r
            parts.setdefault(self.ids[a + b], (i, j, r))
        self.lookahead = max(map(len, self.ids))
        self.parts, self.never = parts, len(model["merges"]) + 1
        self._automaton([(s, i) for s, i in self.ids.items() if len(s) == 1 or i in parts])
        self.pairs: dict[int, bool] = {}

    def _automaton(self, tokens: list[tuple[str, int]]) -> None:
        """States are prefixes of tokens; ``ends`` lists a state's tokens (id, length) that end there, longest first."""
        self.go: dict[int, int] = {}
        depth, fail, own = [0], [0], [-1]
        for s, i in sorted(tokens):
            at = 0
            for c in s:
                key = at << 21 | ord(c)
                to = self.go.get(key)
                if to is None:
                    to = self.go[key] = len(depth)
                    depth.append(depth[at] + 1)
                    fail.append(0)
                    own.append(-1)
                at = to
            own[at] = i
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        self.fail = fail
        trie = dict(self.go)
        for key, to in sorted(trie.items(), key=lambda x: depth[x[1]]):
            at, c = key >> 21, key & 0x1FFFFF
            if at:
                back = fail[at]
                while back and back << 21 | c not in trie:
                    back = fail[back]
                fail[to] = trie.get(back << 21 | c, 0)
            self.ends[to] = (((own[to], depth[to]),) if own[to] >= 0 else ()) + self.ends[fail[to]]
        self.steps = len(self.go) + CACHE_PAIRS

    def move(self, state: int, c: int) -> int:
        """The next state where the token tree has no such branch; kept for the next time."""
        back, to = state, None
        while to is None and back:
            back = self.fail[back]
            to = self.go.get(back << 21 | c)
        if len(self.go) < self.steps:
            self.go[state << 21 | c] = to or 0
        return to or 0

    def plain_bytes(self, i: int) -> bytes:
        """The bytes that an id stands for; a word's end is a space."""
        piece = self.piece[i].decode()
        if piece in self.special:
            return self.piece[i]
        ends = bool(self.end) and piece.endswith(self.end)
        return bytes(BYTE_OF[c] for c in (piece[: -len(self.end)] if ends else piece)) + b" " * ends

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that takes it up) along the token's left (0) or right (1) edge, from the token inward."""
        out, until = [], self.never
        while True:
            out.append((token, until))
            made = self.parts.get(token)
            if made is None:
                return out
            until, token = made[2], made[side]

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's symbols together is a, b."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known, rank, left = True, self.rank, self.spine(b, 0)
            for r, until_r in self.spine(a, 1):
                for le, until_le in left:
                    k = rank.get(r << 20 | le)
                    # of equal merges the left one comes first
                    if k is not None and k < until_r and k <= until_le:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known


NONE = (-2, 0)


class Transducer:
    """Encodes one word, fed as code points of its symbols; ``feed`` returns the ids that have become stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.every = 4 * merges.lookahead
        self.start()

    def start(self) -> None:
        #: For every prefix since the last joint its last token and that token's length; first, the last emitted token.
        self.chain: list[tuple[int, int]] = [(-1, 0)]
        self.state = 0
        self.peak = 0

    def feed(self, symbols: Iterable[int]) -> list[int]:
        out: list[int] = []
        m, chain, state, every = self.m, self.chain, self.state, self.every
        get, ends, known, beside = m.go.get, m.ends, m.pairs.get, m.beside
        i = len(chain)
        for c in symbols:
            to = get(state << 21 | c)
            state = m.move(state, c) if to is None else to
            for last in ends[state]:
                t, n = last
                if n <= i:
                    a = chain[i - n][0]
                    if a == -1:
                        break
                    if a >= 0:
                        fits = known(a << 20 | t)
                        if fits or fits is None and beside(a, t):
                            break
            else:
                last = NONE
            chain.append(last)
            i += 1
            if i > every:
                out += self._emit(self._joint())
                chain = self.chain
                i = len(chain)
        self.state = state
        return out

    def _joint(self) -> int:
        """The last place that the chains from all places where a token may still start go through."""
        chain, n = self.chain, len(self.chain) - 1
        self.peak = max(self.peak, n)
        live = {p for p in range(max(0, n - self.m.lookahead + 1), n + 1) if chain[p][0] >= -1}
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            live.add(p - chain[p][1])
        return live.pop()

    def _emit(self, p: int) -> list[int]:
        chain, ids, upto = self.chain, [], p
        while p > 0:
            t, n = chain[p]
            ids.append(t)
            p -= n
        ids.reverse()
        if ids:
            self.chain = [(ids[-1], 0), *chain[upto + 1 :]]
        return ids

    def finish(self) -> list[int]:
        self.peak = max(self.peak, len(self.chain) - 1)
        ids = self._emit(len(self.chain) - 1)
        self.chain, self.state = [(-1, 0)], 0
        return ids


class Decoder:
    """Ids to text, a piece at a time."""

    def __init__(self, merges: Merges, pieces: bool = True):
        self.m, self.pieces = merges, pieces
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.any = False

    def feed(self, ids: Iterable[int]) -> str:
        m = self.m
        if not self.pieces:
            return self.utf8.decode(b"".join([m.plain_bytes(i) for i in ids if i in m.piece]))
        some = [b" " + m.piece[i] for i in ids if i in m.piece]
        joined = b"".join(some)
        if not self.any and some:
            self.any, joined = True, joined[1:]
        return self.utf8.decode(joined)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class Encoder:
    """Texts to ids, stretch by stretch."""

    def __init__(self, merges: Merges, cache_words: int = CACHE_WORDS):
        self.m = merges
        self.bytes_to = {b: ord(c) for b, c in byte_alphabet().items()}
        self.one = Transducer(merges)
        self.back = Decoder(merges)
        #: Two generations of pre-tokens, the older goes when the newer is full: number of ids, the ids and the decoded
        #: pieces, both with a space before each. The pieces of a pre-token are whole characters.
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.most = cache_words
        self.odd = False

    def core(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if word.isascii() and word.isprintable():
            symbols = [*word.encode()]
        else:
            symbols = [self.bytes_to[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += ENDS
        one = self.one
        ids = one.feed(symbols)
        return ids + one.finish()

    def piece(self, word: str) -> tuple[int, str, str]:
        """A word that is not known yet. ``odd`` tells of code points that only the library splits for sure; such words are not kept."""
        found = self.older.get(word)
        if found is None:
            ids = self.core(word)
            self.back.any = True
            found = (len(ids), " " + " ".join(map(str, ids)), self.back.feed(ids))
        if not word.isascii() and unsure().search(word):
            self.odd = True
        elif len(word) <= 64:
            if len(self.known) >= self.most:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def pre(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii() or not unsure().search(text):
            return _pre(text)
        rules = self.m.rules
        found = rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))
        return [bytes(BYTE_OF[c] for c in word).decode() for word, _ in found]

    def parts(self, text: str) -> Iterator[str | int]:
        """Pre-tokens (str) and special tokens (id) in order."""
        split = self.m.special_split
        at = 0
        if split is not None and "<" in text:
            for found in split.finditer(text):
                yield from self.pre(text[at : found.start()])
                yield self.m.special[found[0]]
                at = found.end()
        yield from self.pre(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for some in _stretches(text):
            for x in self.parts(some):
                if isinstance(x, int):
                    out.append(x)
                else:
                    out += self.core(x)
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text; both hashed as they come."""
        piece, n = self.piece, 0
        ids, pieces = hashlib.sha256(), hashlib.sha256()
        for some in _stretches(text):
            get = self.known.get
            if "<|" in some and self.m.special_split.search(some):
                got = [(1, f" {x}", " " + self.m.piece[x].decode()) if isinstance(x, int) else get(x) or piece(x) for x in self.parts(some)]
            else:
                # every code point but white space is in a pre-token, whichever way it is split
                self.odd = False
                got = [get(x) or piece(x) for x in _pre(some)]
                if self.odd:
                    got = [get(x) or piece(x) for x in self.pre(some)]
            if got:
                skip = n == 0
                count, a, b = zip(*got)
                n += sum(count)
                ids.update("".join(a)[skip:].encode())
                pieces.update("".join(b)[skip:].encode())
        return n, ids.hexdigest(), pieces.hexdigest()


@functools.lru_cache(1)
def unsure() -> re.Pattern:
    """The code points that Python's tables leave unassigned, and those of ``LATER``."""
    ranges, start = [], None
    for c in range(0x110001):
        none = c < 0x110000 and (unicodedata.category(chr(c)) == "Cn" or LATER[0] <= c <= LATER[1])
        if none and start is None:
            start = c
        elif not none and start is not None:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


def _pre(text: str) -> list[str]:
    """Pre-tokens of a text without special tokens."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return SPLIT.findall(RUN.sub(" ", text).lower() if "'" in text else text.lower())


def _stretches(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in pieces of about ``size`` code points, each up to a blank."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n:
            found = BLANK.search(text, stop)
            stop = found.start() if found else n
        yield text if n == stop and not at else text[at:stop]
        at = stop


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(merges(path))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. path: the vocabulary file, at one place on all machines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or word_bpe())
        gc.disable()  # nothing here makes cycles, and looking for them among cached words takes long
        try:
            for batch in batches:
                got = [own.digest(x.as_py() or "") for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            own.older = {}
            gc.enable()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_digests(table(spark, sf_dir, "documents"))
