"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

A line's features are shares of byte classes, its length, its words' length, how many of its words repeat the one
before, and how often it has been seen before in its text, each cut into bins, so that a linear model can follow any curve. They are counted on the bytes of a whole Arrow batch at once.
The field is trained here: documents labelled with quality 1 lend the label content to their lines, those with
quality 0 boilerplate, weighted so that both kinds and long and short documents count alike. Viterbi decoding labels
the lines of every text, and a text stays if content lines hold at least ``MIN_SHARE`` of its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrow import id_and_text, slices, utf8

#: Labelled documents that the field is fitted on, at most: those with the smallest hash of doc_id. Everything else covers all rows.
TRAIN_DOCS = 4000
MIN_SHARE = 0.5
PIECE = 1 << 20

_KINDS = ("lower", "upper", "digit", "space", "stop", "comma", "mark", "pipe", "symbol", "high", "rest")
_CLASS = np.full(256, _KINDS.index("rest"), np.uint8)
for _kind, _chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t\r"), ("stop", b".?:;"), ("comma", b",'\"()-"), ("mark", b"!"), ("pipe", b"|"), ("symbol", b"#$%&*+/<=>@[\\]^_`{}~")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _KINDS.index(_kind)
_CLASS[128:] = _KINDS.index("high")

_SHARES = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8])
_SIZES = np.array([1, 10, 20, 40, 80, 160, 320, 640, 1280, 5000])
_WORDS = np.array([2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14])
_SEEN = np.array([1, 2, 4])
#: (name, edges of its bins)
FEATURES = (*((k, _SHARES) for k in _KINDS), ("size", _SIZES), ("word", _WORDS), ("again", _SHARES), ("seen", _SEEN))
WIDTHS = np.array([len(e) + 1 for _, e in FEATURES])
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
N_BINS = int(WIDTHS.sum())


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, row, chars) of each non-blank line: a column of bins for each feature, its row, and its length in characters."""
    out = [[], [], []]
    for first, end in slices(offsets, PIECE):
        part = data[offsets[first] : offsets[end]]
        row_starts = offsets[first : end + 1] - offsets[first]
        if not len(part):
            continue
        newline = np.flatnonzero(part == 10)
        starts = np.unique(np.concatenate([row_starts[:-1], newline + 1]))
        starts = starts[starts < len(part)]
        ends = np.concatenate([starts[1:], [len(part)]])
        line = np.zeros(len(part), np.int32)
        line[starts[1:]] = 1
        np.cumsum(line, out=line)
        kinds = len(_KINDS)
        counts = np.bincount(line * kinds + _CLASS[part], minlength=len(starts) * kinds).reshape(-1, kinds).astype(np.float64)
        continued = np.add.reduceat(((part & 0xC0) == 0x80).astype(np.int32), starts)
        # The newline itself is one of the rest.
        has_newline = part[ends - 1] == 10
        counts[:, _KINDS.index("rest")] -= has_newline
        size = counts.sum(1)
        chars = (size - continued).astype(np.int64)
        row = np.searchsorted(row_starts, starts, "right") - 1 + first
        solid = size > counts[:, _KINDS.index("space")]
        # Prefix sums of a polynomial over the bytes tell equal lines of a text, and words that equal the one before.
        powers, inverse = _powers(len(part) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)])])
        value = (prefix[ends - has_newline] - prefix[starts]) * inverse[starts]
        again = _again(part, prefix, powers, line, len(starts))
        seen = _rank_among_equal(row, value)
        words = size / (counts[:, _KINDS.index("space")] + 1)
        columns = [*(counts / np.maximum(size, 1)[:, None]).T, size, words, again / (counts[:, _KINDS.index("space")] + 1), seen]
        bins = np.stack([STARTS[k] + np.searchsorted(edges, columns[k], "right") for k, (_, edges) in enumerate(FEATURES)], 1).astype(np.int16)
        for to, values in zip(out, (bins, row, chars), strict=True):
            to.append(values[solid])
    if not out[0]:
        return np.zeros((0, len(FEATURES)), np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in out)


_BASE = 0x9E3779B97F4A7C15
_KNOWN: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    if len(_KNOWN[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _KNOWN[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)
    return _KNOWN[0], _KNOWN[1]


def _again(part: np.ndarray, prefix: np.ndarray, powers: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """In each line, the words that equal the word before."""
    cut = np.flatnonzero((part == 32) | (part == 10))
    s, e = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(part)]])
    solid = e > s
    s, e = s[solid], e[solid]
    if len(s) < 2:
        return np.zeros(lines)
    word = prefix[e] - prefix[s]
    same = (word[1:] == word[:-1] * powers[s[1:] - s[:-1]]) & (e[1:] - s[1:] == e[:-1] - s[:-1]) & (line[s[1:]] == line[s[:-1]])
    return np.bincount(line[s[1:]], same, minlength=lines)


def _rank_among_equal(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many earlier lines of the same row have the same value."""
    order = np.lexsort((np.arange(len(row)), value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.arange(len(r))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(r), np.int64)
    out[order] = rank
    return out


@dataclass
class Field:
    """Weights of a field over the labels boilerplate (0) and content (1)."""

    state: np.ndarray
    step: np.ndarray
    start: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        """All is content: what holds where there is nothing to learn from."""
        f = cls(np.zeros((N_BINS, 2)), np.zeros((2, 2)), np.zeros(2))
        f.start[1] = f.step[:, 1] = 1.0
        return f

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), 2))
        for k in range(bins.shape[1]):
            out += self.state[bins[:, k]]
        return out

    def viterbi(self, bins: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best labels; lines of a row follow each other. Ties go to content."""
        n = len(row)
        if not n:
            return np.zeros(0, np.int8)
        scores = self.scores(bins)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sizes = np.diff(np.concatenate([first, [n]]))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        back = np.zeros((n, 2), np.int8)
        best = scores[first] + self.start
        # All rows take their t-th line at once; the longer ones come first, so those still going are a head of the list.
        for t in range(1, int(sizes[0])):
            going = int(np.searchsorted(-sizes, -t, "left"))
            now = best[:going, :, None] + self.step[None]
            pick = (now[:, 1] >= now[:, 0]).astype(np.int8)
            at = first[:going] + t
            back[at] = pick
            best[:going] = np.where(pick, now[:, 1], now[:, 0]) + scores[at]
        labels = np.zeros(n, np.int8)
        labels[first + sizes - 1] = best[:, 1] >= best[:, 0]
        for t in range(int(sizes[0]) - 1, 0, -1):
            going = int(np.searchsorted(-sizes, -t, "left"))
            at = first[:going] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


def gradient(f: Field, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(value, derivatives by state, step and start) of the conditional log-likelihood of documents, longest first, whose lines' bins are in flat.

    A document has one label for all its lines and counts ``weight`` for each of them.
    """
    first, longest = np.cumsum(sizes) - sizes, int(sizes[0])
    line_weight, line_label = np.repeat(weight, sizes), np.repeat(labels, sizes)
    scores = f.scores(flat)
    alpha, beta = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
    alpha[first] = scores[first] + f.start
    for t in range(1, longest):
        g = int(np.searchsorted(-sizes, -t, "left"))
        at = first[:g] + t
        alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + f.step[0], alpha[at - 1, 1, None] + f.step[1]) + scores[at]
    for t in range(longest - 1, 0, -1):
        g = int(np.searchsorted(-sizes, -t, "left"))
        at = first[:g] + t
        after = beta[at] + scores[at]
        beta[at - 1] = np.logaddexp(f.step[:, 0] + after[:, 0, None], f.step[:, 1] + after[:, 1, None])
    z = np.logaddexp(*alpha[first + sizes - 1].T)
    z_line = np.repeat(z, sizes)
    p = np.exp(alpha + beta - z_line[:, None])
    delta = -p
    delta[np.arange(len(flat)), line_label] += 1
    delta *= line_weight[:, None]
    grad_state = np.stack([np.bincount(flat.ravel(), np.repeat(delta[:, y], flat.shape[1]), minlength=N_BINS) for y in (0, 1)], 1)
    grad_step = np.zeros((2, 2))
    inner = np.ones(len(flat), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    w = line_weight[at]
    for a in (0, 1):
        for b in (0, 1):
            pair = np.exp(alpha[at - 1, a] + f.step[a, b] + scores[at, b] + beta[at, b] - z_line[at])
            grad_step[a, b] = (w * ((line_label[at] == a) & (line_label[at] == b))).sum() - (w * pair).sum()
    grad_start = delta[first].sum(0)
    gold = scores[np.arange(len(flat)), line_label]
    gold[at] += f.step[line_label[at - 1], line_label[at]]
    gold[first] += f.start[labels]
    return float(weight @ (np.add.reduceat(gold, first) - z)), [grad_state, grad_step, grad_start]


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Fit the field to (bins of a document's lines, label of all of them) by gradient ascent (Adam) on the weighted conditional log-likelihood."""
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    labels = np.array([y for _, y in docs])
    if len(set(labels.tolist())) < 2:
        return Field.blank()
    sizes = np.array([len(b) for b, _ in docs])
    flat = np.concatenate([b for b, _ in docs])
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    f = Field(np.zeros((N_BINS, 2)), np.zeros((2, 2)), np.zeros(2))
    params = [f.state, f.step, f.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        for k, g in enumerate(gradient(f, flat, sizes, labels, weight / sizes)[1]):
            g = g - decay * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] += rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-9)
    return f


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> list[tuple[np.ndarray, int]]:
    """(bins of the lines, quality) of at most ``most`` labelled documents, chosen by a hash of doc_id."""
    sample = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "id").select("text", "quality", "id")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            bins, row, _ = line_features(data, offsets)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            raw = [bins[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(raw, pa.binary())], ["id", "quality", "bins"])

    # Rows that repeat may exceed the bound; order makes the sum, and so the fit, the same on every run.
    found = texts.mapInArrow(run, "id long, quality int, bins binary").orderBy("id", "bins").limit(most).collect()
    return [(np.frombuffer(r.bins, np.int16).reshape(-1, len(FEATURES)), r.quality) for r in found]


def train_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> Field:
    """A field fitted to the labelled documents; one that calls everything content if there aren't both kinds."""
    return train(training_rows(docs, labels, id_col, text_col, most))


def _judge(field: Field, texts: pa.Array, min_share: float):
    """(lines, content lines, share, keep) of each text."""
    data, offsets = utf8(texts)
    bins, row, chars = line_features(data, offsets)
    label = field.viterbi(bins, row)
    n = len(offsets) - 1
    lines, content = np.bincount(row, minlength=n), np.bincount(row, label, minlength=n).astype(np.int64)
    total = np.bincount(row, chars, minlength=n)
    share = np.bincount(row, chars * label, minlength=n) / np.maximum(total, 1)
    return lines, content, np.round(share, 6), (share >= min_share) & (total > 0)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_lines, content_lines, content_share, keep) for each row of docs.

    Lines are what newlines part; blank ones don't count. Null, empty and blank texts have no lines, share 0, and aren't kept.
    Rows that repeat are judged each, rows without a doc_id too. An empty table gives an empty result; other columns
    are ignored. Labels other than 0 and 1 are left out; of several labels of a doc_id the highest counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(train_field(docs, labels, id_col, text_col))

    def run(batches):
        for batch in batches:
            lines, content, share, keep = _judge(held.value, batch.column(1), min_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(content, pa.int64()), pa.array(share), pa.array(keep)], ["doc_id", "n_lines", "content_lines", "content_share", "keep"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_lines long, content_lines long, content_share double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, all columns as they are, whose texts :func:`quality` keeps."""
    held = docs.sparkSession.sparkContext.broadcast(train_field(docs, labels, id_col, text_col))

    def run(batches):
        for batch in batches:
            keep = _judge(held.value, batch.column(batch.schema.get_field_index(text_col)), min_share)[3]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
