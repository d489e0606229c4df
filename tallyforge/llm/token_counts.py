"""Token counts by rank-synchronous merging of ragged numpy arrays.

The vocabulary is a SentencePiece BPE model with byte fallback. A text is taken apart into
pre-tokens at places that no piece can span; equal pre-tokens are counted once and remembered.
The new ones of a batch are laid end to end in one array of symbols. In each round every
pre-token finds its lowest-ranked adjacent pair and all pre-tokens apply theirs at the same time,
until no pair is left. The surviving symbols are the tokens; a character without a piece counts
as its UTF-8 bytes.

Within one pre-token all places of the lowest rank are joined in one round, leftmost first. That
equals joining them one after the other unless a join offers a new pair of the same or a lower
rank; a pre-token where that happens joins only its leftmost place in that round.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SPACE = "▁"
#: Pre-tokens remembered by one task at most, and the longest of them in characters.
MEMORY_ENTRIES, MEMORY_CHARS = 300_000, 64
NONE = np.int64(1) << 60


class PieceCounter:
    """Counts tokens of texts as the SentencePiece library would with the given model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("a BPE model with byte fallback, identity normalisation and kept white space is expected")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        symbols = {}
        for piece in pieces:
            symbols.setdefault(piece, len(symbols))
        for c in sorted({c for piece in pieces for c in piece}):
            symbols.setdefault(c, len(symbols))
        self.symbols = symbols
        #: tokens that a surviving symbol stands for
        cost = [1 if s in pieces else len(s.encode()) for s in symbols]
        self.cost = np.array([*cost, 0], dtype=np.int64)
        self.stray = len(symbols)
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, values = [], []
        for piece, score in pieces.items():
            for k in range(1, len(piece)):
                if (a := symbols.get(piece[:k])) is not None and (b := symbols.get(piece[k:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(order[score] << 20 | symbols[piece])
        sort = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[sort], NONE)
        self.values = np.append(np.array(values, dtype=np.int64)[sort], NONE)
        joined = {c for piece in pieces if len(piece) > 1 for c in piece if c != SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has white space after its start")
        inner = "".join(map(re.escape, sorted(joined)))
        self.split = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]").findall
        self.known: dict[str, int] = {}

    def ranks(self, row: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank << 20 | joined symbol of the pairs that begin at the places ``at``, NONE without one."""
        key = row[at] << 20 | row[np.minimum(at + 1, len(row) - 1)]
        found = np.searchsorted(self.keys, key)
        return np.where((self.keys[found] == key) & ~last[at], self.values[found], NONE)

    def merge(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        get, stray = self.symbols.get, self.stray
        row = np.array([get(c, stray) for w in words for c in w], dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        total = np.zeros(len(words), dtype=np.int64)
        lone = row == stray
        if lone.any():
            chars = "".join(words)
            extra = np.array([len(chars[i].encode()) for i in np.flatnonzero(lone)], dtype=np.int64)
            np.add.at(total, owner[lone], extra)
        last = np.append(owner[1:] != owner[:-1], True)
        rank = self.ranks(row, last, np.arange(len(row)))
        while len(row):
            start = np.flatnonzero(np.append(True, last[:-1]))
            count = np.diff(np.append(start, len(row)))
            low = np.minimum.reduceat(rank, start) >> 20
            done = low == NONE >> 20
            if done.any():
                # finished pre-tokens leave the arrays
                fixed = np.repeat(done, count)
                np.add.at(total, owner[fixed], self.cost[row[fixed]])
                live = ~fixed
                row, owner, rank, last = row[live], owner[live], rank[live], last[live]
                low, count = low[~done], count[~done]
                if not len(row):
                    break
                start = np.cumsum(count) - count
            hit = (rank >> 20) == np.repeat(low, count)
            # of touching places, every second one counting from the left of the run
            place = np.arange(len(row))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, -1))
            hit &= (place - run) % 2 == 0
            lefts = np.add.reduceat(hit, start, dtype=np.int64)
            made = self.joined(row, rank, last, hit)
            if (lefts > 1).any():
                spot = np.cumsum(np.add.reduceat(made[3], start, dtype=np.int64))
                again = np.minimum.reduceat(made[1], np.append(0, spot[:-1])) >> 20 <= low
                again &= lefts > 1
                if again.any():
                    leftmost = np.minimum.reduceat(np.where(hit, place, len(row)), start)
                    hit &= ~np.repeat(again, count) | (place == np.repeat(leftmost, count))
                    made = self.joined(row, rank, last, hit)
            row, rank, last, kept = made
            owner = owner[kept]
        return total

    def joined(self, row: np.ndarray, rank: np.ndarray, last: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols, ranks and ends after joining the pairs at ``hit``, and which places are left."""
        right = np.append(False, hit[:-1])
        kept = ~right
        row = np.where(hit, rank & 0xFFFFF, row)[kept]
        last = np.where(hit, np.append(last[1:], True), last)[kept]
        new, rank = hit[kept], rank[kept]
        # only pairs with a joined symbol on one side are looked up anew
        at = np.flatnonzero(new | (np.append(new[1:], False) & ~last))
        rank[at] = self.ranks(row, last, at)
        return row, rank, last, kept

    def count(self, texts: list[str | None]) -> list[int]:
        known = self.known
        parts = [self.split((self.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*parts).difference(known))
        if fresh:
            known.update(zip(fresh, self.merge(fresh).tolist(), strict=True))
        look = known.__getitem__
        out = [sum(map(look, words)) for words in parts]
        for w in fresh:
            if len(w) > MEMORY_CHARS:
                del known[w]
        if len(known) > MEMORY_ENTRIES:
            known.clear()
        return out


def count_tokens(df: DataFrame, model: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """``carry`` columns and the number of tokens of each text, without begin or end marks.

    Null and empty texts have 0 tokens. Repeated rows each give a row. Texts are counted whole,
    whatever their length; other columns are neither read nor passed on.
    """
    from tallyforge.llm.arrowtext import map_column

    def make():
        counter = PieceCounter(model)
        return lambda texts: [pa.array(counter.count(texts), pa.int64())]

    return map_column(df, text, T.StructType([T.StructField(out, T.LongType())]), make, list(carry))
