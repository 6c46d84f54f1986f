"""Byte-level BPE by prefix dynamic programming, and its inverse.

For every prefix of a byte string exactly one token can end the BPE encoding of that prefix: the one that is a
suffix of the prefix, encodes alone as itself, and is compatible with the last token of what precedes it. So one array of last tokens is the
encoding of all prefixes at once: appending extends it, and an edit recomputes it from the edit on until it runs
like the old one for a whole longest token. Two tokens are compatible if BPE would not merge across their border,
which is found by taking both apart along the border in the reverse order of merges.

A vocabulary is a file of ``base64 rank`` lines; its path is a parameter. BPE runs within pre-tokens.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with the standard library's classes, twice as fast; right for texts without the characters of odd_characters().
FAST_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Vocabularies are broadcast; a larger file than this is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose encoding a worker remembers; beyond that it forgets all and starts again.
CACHE = 250_000


@lru_cache(1)
def odd_characters() -> str:
    """A class of all characters that the two patterns' libraries class differently."""
    kinds = [(re.compile(a), regex.compile(b)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))]
    odd = []
    for start in range(0, sys.maxunicode + 1, 4096):
        block = "".join(chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        for a, b in kinds:
            odd += set(a.findall(block)) ^ set(b.findall(block))
    points = sorted({ord(c) for c in odd})
    spans: list[list[int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


#: Anything but characters that are known to be classed alike; only texts with one of these are searched for odd ones.
_UNSURE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba-\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]"


class Splitter:
    """Pre-tokens of a text."""

    def __init__(self, odd: str | None = None):
        self.fast, self.exact, self.odd, self.unsure = re.compile(FAST_PATTERN), regex.compile(PATTERN), re.compile(odd or odd_characters()), re.compile(_UNSURE)

    def __call__(self, text: str) -> list[str]:
        return self.exact.findall(text) if self.unsure.search(text) and self.odd.search(text) else self.fast.findall(text)


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def merge(ranks: dict[bytes, int], piece: bytes, below: int = 1 << 62) -> list[bytes]:
    """BPE of piece by merging the pair of lowest rank again and again, as far as ranks are below the given one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(ranks, parts, below)
    look = ranks.get
    costs = [look(piece[i : i + 2], below) for i in range(len(piece) - 1)]
    while costs and (best := min(costs)) < below:
        at = costs.index(best)
        parts[at] = both = parts[at] + parts[at + 1]
        del parts[at + 1], costs[at]
        if at:
            costs[at - 1] = look(parts[at - 1] + both, below)
        if at < len(costs):
            costs[at] = look(both + parts[at + 1], below)
    return parts


def _merge_long(ranks: dict[bytes, int], parts: list, below: int) -> list[bytes]:
    """The same with a heap of pairs, for pieces where the quadratic loop would take long."""
    import heapq

    n, look = len(parts), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := look(parts[i] + parts[i + 1], below)) < below]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := look(parts[i] + parts[k], below)) < below:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := look(parts[h] + parts[i], below)) < below:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


class PrefixBPE:
    """A vocabulary with the tables that prefix encoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        for token, i in ranks.items():
            if len(token) == 1:
                self.halves[i] = i, i
                self.usable[token] = i
            elif len(halves := merge(ranks, token, i)) == 2:
                a, b = ranks[halves[0]], ranks[halves[1]]
                self.halves[i], self.pairs[a, b] = (a, b), i
                self.usable[token] = i
        self._fits: dict[int, bool] = {}
        self._automaton()
        width = max(self.tokens) + 1
        self._sizes = np.zeros(width, np.int64)
        for i, t in self.tokens.items():
            self._sizes[i] = len(t)
        self._starts = np.concatenate([[0], np.cumsum(self._sizes)[:-1]])
        self._bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(width)), np.uint8)

    def _automaton(self) -> None:
        """Aho-Corasick over the usable tokens: ends[state] has (token, bytes) for each that ends there, the longest first."""
        steps, depth, own = {}, [0], [None]
        for token, i in self.usable.items():
            state = 0
            for byte in token:
                to = steps.get(state << 8 | byte)
                if to is None:
                    to = steps[state << 8 | byte] = len(depth)
                    depth.append(depth[state] + 1)
                    own.append(None)
                state = to
            own[state] = i, len(token)
        self.fail, self.ends, self.steps = [0] * len(depth), [()] * len(depth), steps
        for key, to in sorted(steps.items(), key=lambda x: depth[x[1]]):
            if depth[to] > 1:
                self.fail[to] = self._next(self.fail[key >> 8], key & 255)
            longer = self.ends[self.fail[to]]
            self.ends[to] = (own[to], *longer) if own[to] else longer

    def _next(self, state: int, byte: int) -> int:
        """The automaton's next state, which is remembered as a step of its own."""
        found = self.steps.get(state << 8 | byte)
        if found is None:
            found = self._next(self.fail[state], byte) if state else 0
            if len(self.steps) < 3_000_000:
                self.steps[state << 8 | byte] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b is a, b."""
        known = self._fits.get(a << 32 | b)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        """Undo the later merge beside the border, and see if the halves there would have merged before it."""
        limit = 1 << 62
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            left, right = self.halves[a][1], self.halves[b][0]
            a_whole, b_whole = left == a, right == b
            if a_whole and b_whole:
                return True
            # Of equal pairs the leftmost merges first: of equal tokens the right one is the later, and a pair over the border comes before an equal one in b.
            if not a_whole and (b_whole or a > b):
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def extend(self, data: bytes, last: list[int], start: int, stop: int | None = None) -> list[int]:
        """last[i] for each prefix data[:i + 1], from start on; last holds what comes before start."""
        steps, ends, fits, known, state = self.steps.get, self.ends, self.compatible, self._fits.get, 0
        for byte in data[max(0, start - self.longest) : start]:
            state = self._next(state, byte)
        at = start
        for byte in data[start:stop]:
            to = steps(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            at += 1
            for token, size in ends[state]:
                if size == at:
                    break
                before = last[at - size - 1]
                if (fit := known(before << 32 | token)) or fit is None and fits(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        return self.walk(self.extend(data, [], 0))

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(list(ids) if not isinstance(ids, np.ndarray) else ids, np.int64)
        if not len(ids):
            return b""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        return self._bytes[np.arange(ends[-1]) + np.repeat(self._starts[ids] - ends + sizes, sizes)].tobytes()


class PrefixEncoding:
    """The encoding of all prefixes of one piece, kept up to date under appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.extend(data, [], 0)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.bpe.extend(self.data, self.last, start)

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Put new in place of data[begin:end]; the number of prefixes that had to be computed again."""
        if not 0 <= begin <= end <= len(self.data):
            raise ValueError("begin and end must lie within the data, in order")
        old, tail = self.last, self.last[end:]
        self.data = self.data[:begin] + new + self.data[end:]
        self.last = old[:begin]
        same, at, edge = 0, begin, begin + len(new)
        while at < len(self.data):
            self.bpe.extend(self.data, self.last, at, at + 1)
            at += 1
            if at > edge:
                # A prefix's last token needs nothing further back than a longest token: after so many equal ones all are.
                same = same + 1 if self.last[-1] == tail[at - edge - 1] else 0
                if same >= self.bpe.longest:
                    self.last += tail[at - edge :]
                    break
        return at - begin

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes; of all by default."""
        return self.bpe.walk(self.last if end is None else self.last[:end])


class TextEncoding:
    """The encoding of a text, pre-token by pre-token, kept up to date under appends and edits.

    The split looks ahead by at most two pre-tokens and never back, so it starts again three pre-tokens before a change, and ends as soon
    as it comes upon an old border behind the change.
    """

    LOOK = 3

    def __init__(self, bpe: PrefixBPE, splitter: Splitter, text: str = ""):
        self.bpe, self.splitter, self.text = bpe, splitter, text
        self.pieces = [(p, bpe.encode_piece(p.encode())) for p in splitter(text)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> None:
        if not 0 <= begin <= end <= len(self.text):
            raise ValueError("begin and end must lie within the text, in order")
        ends = np.cumsum([len(p) for p, _ in self.pieces]).tolist()
        first = max(0, int(np.searchsorted(ends, begin)) - self.LOOK)
        start, shift = (ends[first - 1] if first else 0), len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        borders = {e + shift: k + 1 for k, e in enumerate(ends) if e >= end}
        head, at, fresh = self.pieces[:first], start, []
        # Pieces come lazily, so that the split ends where it meets an old border.
        for found in self.splitter.exact.finditer(self.text, start):
            piece = found.group()
            fresh.append((piece, self.bpe.encode_piece(piece.encode())))
            at = found.end()
            if at >= begin + len(new) and at in borders:
                self.pieces = head + fresh + self.pieces[borders[at] :]
                return
        self.pieces = head + fresh

    def tokens(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]


class _Known(dict):
    """Packed ids of pre-tokens; those not met before are encoded."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        packed = np.array(self.bpe.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


@lru_cache(2)
def _worker(vocabulary: bytes, odd: str) -> tuple[PrefixBPE, Splitter, _Known]:
    bpe = PrefixBPE(parse_vocabulary(vocabulary))
    return bpe, Splitter(odd), _Known(bpe)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): each text encoded, and whether decoding gives its bytes again.

    Null texts give null in all three; an empty text gives no ids. Rows that repeat are encoded each; other columns are
    ignored; an empty table gives an empty result. Texts of any length are encoded whole.
    """
    held = docs.sparkSession.sparkContext.broadcast((read_vocabulary(vocabulary), odd_characters()))

    def run(batches):
        bpe, split, known = _worker(*held.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at, held_bytes = 0, 0
            packed, fits = [], []
            for k, text in enumerate(texts):
                raw = None if text is None else b"".join(map(known.__getitem__, split(text)))
                packed.append(raw)
                fits.append(None if raw is None else bpe.decode(np.frombuffer(raw, np.int32)) == text.encode())
                held_bytes += len(raw or b"")
                if held_bytes > 16 << 20 or k == len(texts) - 1:
                    sizes = np.array([0 if p is None else len(p) // 4 for p in packed], np.int32)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([p is None for p in packed] + [False]))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p for p in packed if p is not None), np.int32)))
                    counts = pa.array([None if p is None else len(p) // 4 for p in packed], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(packed)), lists, counts, pa.array(fits, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])
                    at, held_bytes, packed, fits = k + 1, 0, [], []

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the texts of id lists. Null lists, lists with a null or unknown id, and bytes that aren't UTF-8 give null.

    An empty list gives an empty text. Rows that repeat are decoded each, rows without an id too; an empty table gives an empty result; other columns are ignored.
    """
    held = encoded.sparkSession.sparkContext.broadcast((read_vocabulary(vocabulary), odd_characters()))

    def text_of(bpe, ids):
        if ids is None or any(i is None or i not in bpe.tokens for i in ids):
            return None
        try:
            return bpe.decode(ids).decode()
        except UnicodeDecodeError:
            return None

    def run(batches):
        bpe = _worker(*held.value)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(bpe, x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
