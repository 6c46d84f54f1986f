"""Token counts with a whole-token shortcut.

Before the job, each string of the vocabulary is run through BPE once: those that come out as one token are proven
to count 1 wherever they occur as a pre-token. A worker looks each pre-token up there, and merges only the rest.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import CACHE, VOCABULARY, Splitter, merge, odd_characters, parse_vocabulary, read_vocabulary


def whole_tokens(ranks: dict[bytes, int]) -> list[str]:
    """The vocabulary's strings that BPE encodes as one token, by encoding each."""
    whole = []
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue  # no pre-token is part of a character
        if len(merge(ranks, token)) == 1:
            whole.append(text)
    return whole


class Counts(dict):
    """Tokens of a pre-token: 1 for the proven, else by merging.

    What was merged is remembered in two generations: when the younger is full it becomes the older, and what is
    asked for again moves up, so that frequent pre-tokens are never forgotten.
    """

    def __init__(self, ranks: dict[bytes, int], whole: list[str], size: int = CACHE):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.size, self.old = whole, size, {}
        # One piece is the whole string: merging is all that is left to the library.
        self.merged = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.merged(piece))
        if len(piece) <= 64:
            if len(self) >= self.size // 2 + len(self.whole):
                self.old = dict(self)
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


@lru_cache(2)
def _worker(vocabulary: bytes, odd: str, whole: tuple[str, ...]) -> tuple[Counts, Splitter, frozenset]:
    return Counts(parse_vocabulary(vocabulary), list(whole)), Splitter(odd), frozenset(whole)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_whole): tokens, pre-tokens, and pre-tokens counted by the shortcut.

    Null texts give null counts, empty ones 0. Rows that repeat are counted each; other columns are ignored; an empty
    table gives an empty result. Texts of any length are counted whole.
    """
    data = read_vocabulary(vocabulary)
    held = docs.sparkSession.sparkContext.broadcast((data, odd_characters(), tuple(whole_tokens(parse_vocabulary(data)))))

    def run(batches):
        counts, split, whole = _worker(*held.value)
        get, proven = counts.__getitem__, whole.__contains__
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    rows.append((None, None, None))
                else:
                    pieces = split(text)
                    rows.append((sum(map(get, pieces)), len(pieces), sum(map(proven, pieces))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_whole long")
