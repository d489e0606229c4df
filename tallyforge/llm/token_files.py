"""Token ids of documents in files coded by a static range asymmetric numeral system.

A file set is a folder with two Parquet tables, so that Spark's writers commit it and any store that
Spark reads can hold it:

``table``   (id, freq): the frequencies that all blocks share, summing to ``1 << BITS``.
``blocks``  one row for each block of at most ``BLOCK`` ids. Documents are laid end to end in order
            of their id, each ended by the end id; a shard is what one task wrote, and documents
            don't cross shards. A block is coded on its own:
            ``shard``, ``block``   its place,
            ``first``, ``n``       ids of the shard before it, and ids in it,
            ``words``              32-bit words that the coder put out, in the decoder's order,
            ``states``, ``places`` checkpoints: the states of all lanes and the number of words read
                                   before every ``SPAN`` steps, where decoding can begin,
            ``words_crc``, ``ids_crc``  checksums of the words and of the decoded ids,
            ``docs``               the documents or parts of documents in it: number in the shard,
                                   id, ids before it in the block, ids of the part, ids of the
                                   document in earlier blocks, and ids of the whole document.

Id number i of a block goes to lane i % LANES, and the lanes take turns in writing words. A step
codes one id in each lane of many blocks with the same few numpy operations; a decoder runs the
stretches between checkpoints of many blocks side by side in the same way.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.llm.bpe_codec import byte_letters
from tallyforge.llm.scratch import Scratch

BITS = 18
LANES, SPAN, BLOCK = 32, 512, 1 << 16
#: Blocks coded side by side, and stretches decoded side by side, at most.
TOGETHER, STRETCHES = 16, 64
LOW = np.uint64(1 << 31)
SHIFT, WORD = np.uint64(BITS), np.uint64(32)
MASK = np.uint64((1 << 32) - 1)
#: Pieces of text remembered by one worker at most, and the longest of them in bytes.
MEMORY_ENTRIES, MEMORY_BYTES = 400_000, 64
#: New pieces that the library is given as one text.
JOINED = 200

BLOCKS = """shard int, block int, first bigint, n int, words binary, states binary, places binary, words_crc bigint, ids_crc bigint,
docs array<struct<number: bigint, id: {id}, at: int, n: int, before: bigint, total: bigint>>"""


# -- token ids ----------------------------------------------------------------------------------


def _bytes(*kinds: int | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for kind in kinds:
        out[kind] = True
    return out


SPACE, STOPS = _bytes(range(9, 14), 32), _bytes(*b".,;:!?")
ASCII_LETTERS = _bytes(range(65, 91), range(97, 123))
#: Bytes of characters that libraries may disagree on as white space, or the first bytes of such characters.
MAYBE_ODD = _bytes(range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3)
#: Second bytes of characters that begin with C3 and are no letters.
NO_LETTER = _bytes(0x97, 0xB7)
#: What a byte of a piece is, and what stands between words that go to the library: no letter of a byte.
LETTER, DIGIT, SIGN, BLANK, BREAK = 1, 2, 3, 4, "\n"


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are of letters of ASCII or Latin-1. The latter have two bytes, of which the first is C3."""
    wide = data[:-1] == 0xC3
    wide &= ~NO_LETTER[data[1:]]
    found = ASCII_LETTERS[data]
    found[:-1] |= wide
    found[1:] |= wide
    return found


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin that lie end to end in ``data``, text i from ``ends[i]`` to ``ends[i + 1]``.

    A piece is white space and what follows it up to the next white space or the end. Where that
    begins with letters before a stop, it is cut before the stop. White space that ends a text is a piece.
    """
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[ends[:-1]] = True
    first = first[:n]
    space, letter = SPACE[data], letters(data)
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins |= first
    # a stop behind a run of letters that has white space or the text's beginning before it
    stop = np.flatnonzero(STOPS[data[1:]] & letter[:-1] & ~first[1:]) + 1 if n else first.nonzero()[0]
    other = np.append(-1, np.flatnonzero(~letter))
    run = np.maximum(other[np.searchsorted(other, stop) - 1] + 1, ends[np.searchsorted(ends, stop, "right") - 1])
    begins[stop[first[run] | space[run - 1]]] = True
    return np.flatnonzero(begins)


def unpacked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string or binary array without nulls, and where its values begin and end in them."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def packed(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A large binary array of these bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which meets each piece of text once.

    No token of a byte-level vocabulary goes from a character that isn't white space to one that
    is, or from a letter to a stop or comma, and what follows doesn't depend on what came before,
    so a text can be cut there. Pieces are found, told apart and remembered in Arrow and numpy, a
    batch of texts at once. Texts with white space that libraries disagree on are encoded in one piece.
    New pieces of Latin letters, digits and signs are split into words here as the file's pattern does it, and go to the
    library's model as words, many at a time; others go through all of the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.odd = re.compile(r"[^\S \t\n\r\v\f]").search
        added = self.library.get_added_tokens_decoder()
        #: bytes that each id stands for: a letter of such a vocabulary is a byte, special tokens are text
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        for i, token in added.items():
            self.size[i] = len(token.content.encode())
        #: what each byte may be in a piece that is split here: 0 nothing
        self.sort = np.zeros(256, dtype=np.uint8)
        how = self.library.pre_tokenizer and json.loads(self.library.pre_tokenizer.__getstate__())
        if self.library.normalizer is None and how and (how["type"], how.get("use_regex"), how.get("add_prefix_space")) == ("ByteLevel", True, False):
            self.sort[33:127], self.sort[ASCII_LETTERS], self.sort[48:58] = SIGN, LETTER, DIGIT
            self.sort[[*b" \t\n\r"]] = BLANK
            # contractions, and what special tokens may begin with
            self.sort[[*b"'", *(t.content.encode()[0] for t in added.values())]] = 0
        self.letter = np.array([ord(c) for c in byte_letters()], dtype="<u4")
        self.words = Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BREAK)
        #: pieces met, and the ids of each
        self.known = self.known_ids = pa.array([], pa.large_binary())

    def fresh(self, pieces: pa.Array) -> pa.Array:
        """The packed ids of each piece."""
        data, ends = unpacked(pieces)
        first, sort = self.sorts(data, ends)
        hard = sort == 0
        hard |= (sort == BLANK) & ~first
        hard[ends[:-1]] |= (sort[ends[:-1]] == BLANK) & (np.diff(ends) == 1)
        plain = ~np.logical_or.reduceat(hard, ends[:-1]) if len(pieces) else hard
        split = self.by_words(pieces.filter(pa.array(plain)))
        others = pa.array(self.unsplit(pieces.filter(pa.array(~plain)).to_pylist()), pa.large_binary())
        place = np.where(plain, np.cumsum(plain), np.cumsum(~plain) + len(split)) - 1
        return pa.concat_arrays([split, others]).take(pa.array(place))

    def sorts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a piece, and what each byte is."""
        first = np.zeros(len(data), dtype=bool)
        first[ends[:-1]] = True
        sort = self.sort[data]
        if self.sort.any():
            sort[letters(data)] = LETTER
        return first, sort

    def by_words(self, pieces: pa.Array) -> pa.Array:
        """The packed ids of pieces that are split into words here."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        data, ends = unpacked(pieces)
        first, sort = self.sorts(data, ends)
        # a word begins where the sort changes, but a space before it is its own
        begins = first
        begins[1:] |= (sort[1:] != sort[:-1]) & (data[:-1] != 0x20)
        text = np.full(len(data) + np.count_nonzero(begins), ord(BREAK), dtype="<u4")
        place = np.arange(len(data)) + np.cumsum(begins)
        text[place] = self.letter[data]
        cuts = [*place[ends[:-1:JOINED]].tolist(), len(text) + 1]
        text = text.tobytes().decode("utf-32-le")
        row = array(self.kind.char)
        for found in self.words.encode_batch_fast([text[a : b - 1] for a, b in pairwise(cuts)], add_special_tokens=False):
            row.extend(found.ids)
        ids = np.array(row, dtype=self.kind)
        until = np.append(0, np.cumsum(self.size[ids]))
        place = np.minimum(np.searchsorted(until, ends), len(ids))
        if not (until[place] == ends).all():
            raise ValueError("ids that go across pieces")
        return packed(ids, place * self.kind.itemsize)

    def unsplit(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece by all of the library. Those that cuts divide on both sides go to it many at a time."""
        inner = [p for p in pieces if p[:1].isspace() and not p[-1:].isspace()]
        runs = [inner[i : i + JOINED] for i in range(0, len(inner), JOINED)]
        out = {}
        for run, found in zip(runs, self.library.encode_batch_fast([b"".join(r).decode() for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.kind)
            ends = np.cumsum([len(p) for p in run])
            raw, at = ids.tobytes(), 0
            for p, end in zip(run, ((np.searchsorted(np.cumsum(self.size[ids]), ends) + 1) * self.kind.itemsize).tolist(), strict=True):
                out[p], at = raw[at:end], end
        outer = [p for p in pieces if p not in out]
        for p, found in zip(outer, self.library.encode_batch_fast([p.decode() for p in outer], add_special_tokens=False), strict=True):
            out[p] = np.array(found.ids, dtype=self.kind).tobytes()
        return [out[p] for p in pieces]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        values = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        data, ends = unpacked(values)
        # a text with a byte of such white space may have it
        odd, whole = MAYBE_ODD[data], []
        if odd.any():
            near = np.diff(np.append(0, np.cumsum(odd))[ends])
            whole = [i for i in np.flatnonzero(near).tolist() if self.odd(values[i].as_py())]
        starts = piece_starts(data, ends)
        found = self.looked_up(data, starts)
        # each document is a stretch of pieces, and its ids are those of the stretch
        raw, cuts = unpacked(found)
        places, raw = cuts[np.searchsorted(starts, ends)].tolist(), memoryview(raw)
        out = [bytes(raw[a:b]) for a, b in pairwise(places)]
        for i, e in zip(whole, self.library.encode_batch_fast([values[i].as_py() for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=self.kind).tobytes()
        return out

    def looked_up(self, data: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The packed ids of each piece."""
        pieces = packed(data, np.append(starts, len(data))).dictionary_encode()
        place = pc.index_in(pieces.dictionary, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = place < 0
        missing = pieces.dictionary.filter(pa.array(new))
        ids = self.fresh(missing)
        place[new] = len(self.known) + np.arange(len(missing))
        found = pa.concat_arrays([self.known_ids, ids])
        short = pc.less_equal(pc.binary_length(missing), MEMORY_BYTES)
        self.known = pa.concat_arrays([self.known, missing.filter(short)])
        self.known_ids = pa.concat_arrays([self.known_ids, ids.filter(short)])
        if len(self.known) > MEMORY_ENTRIES:
            # what came first is what comes most often
            self.known, self.known_ids = self.known[: MEMORY_ENTRIES // 2], self.known_ids[: MEMORY_ENTRIES // 2]
        return found.take(pa.array(place[pieces.indices.to_numpy()]))


@cache
def encoder(path: str) -> PieceEncoder:
    """The encoder of a worker, which keeps the pieces it knows from task to task. Tasks are parallel, the library isn't."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def token_ids(df: DataFrame, tokenizer: str, end: int, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``ids``: the packed ids of each whole text and the end id. Null texts are empty ones."""
    from tallyforge.llm.arrowtext import map_column

    def make():
        own = encoder(tokenizer)
        last = np.array([end], dtype=own.kind).tobytes()
        return lambda texts: [pa.array([x + last for x in own.encode(texts)], pa.binary())]

    return map_column(df, text, T.StructType([T.StructField("ids", T.BinaryType())]), make, list(carry), lists=False)


def id_counts(df: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, n) over all packed ids: each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            values = batch.column(0)
            ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
            raw = values.buffers()[2]
            more = np.bincount(np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]].view(kind)) if raw is not None and len(values) else total[:0]
            if len(more) > len(total):
                total = np.append(total, np.zeros(len(more) - len(total), dtype=np.int64))
            total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return df.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# -- the coder ----------------------------------------------------------------------------------


def frequencies(counts: dict[int, int]) -> dict[int, int]:
    """Whole frequencies of 1 or more that sum to ``1 << BITS``, near the shares of the counts."""
    if not counts:
        return {}
    ids = np.array(sorted(counts))
    n = np.array([float(counts[i]) for i in ids.tolist()])
    room = (1 << BITS) - len(ids)
    if room < 0:
        raise ValueError(f"more than {1 << BITS} different ids")
    share = n / n.sum() * room
    extra = np.floor(share).astype(np.int64)
    # what rounding left goes to the largest remainders, smaller ids first
    order = np.argsort(extra - share, kind="stable")
    extra[order[: room - int(extra.sum())]] += 1
    return dict(zip(ids.tolist(), (extra + 1).tolist(), strict=True))


class Coder:
    """Codes and decodes blocks of ids with one frequency table."""

    def __init__(self, table: dict[int, int]):
        ids = np.array(sorted(table), dtype=np.int64)
        freq = np.array([table[i] for i in ids.tolist()], dtype=np.uint64)
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.freq[ids] = freq
        self.start[ids] = np.cumsum(freq) - freq
        self.limit = self.freq << np.uint64(63 - BITS)
        self.symbol = np.repeat(ids, freq.astype(np.int64)).astype(np.uint32)

    def encode(self, rows: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """(words, states, places) of each row of ids; a later id is coded before an earlier one."""
        k, n = rows.shape
        steps = -(-n // LANES)
        if not self.freq[rows].all():
            raise ValueError("an id without a frequency")
        # by step, so that a step reads one stretch of memory
        padded = np.zeros((k, steps * LANES), dtype=np.int64)
        padded[:, :n] = rows
        padded = np.ascontiguousarray(padded.reshape(k, steps, LANES).swapaxes(0, 1))
        freq, start, limit = self.freq[padded], self.start[padded], self.limit[padded]
        state = np.full((k, LANES), LOW, dtype=np.uint64)
        put: list[np.ndarray] = [None] * steps
        count = np.zeros((steps, k), dtype=np.int64)
        states = []
        for s in range(steps - 1, -1, -1):
            width = min(LANES, n - s * LANES)
            x, f = state[:, :width], freq[s, :, :width]
            full = x >= limit[s, :, :width]
            put[s] = (x[full] & MASK).astype("<u4")
            count[s] = full.sum(1)
            x = np.where(full, x >> WORD, x)
            q = x // f
            state[:, :width] = (q << SHIFT) + (x - q * f) + start[s, :, :width]
            if s % SPAN == 0:
                states.append(state.copy())
        # words lie by step, then block, then lane; each block takes its own in that order
        owner = np.repeat(np.tile(np.arange(k, dtype=np.uint16), steps), count.ravel())
        words = np.concatenate(put)[np.argsort(owner, kind="stable")]
        until = np.cumsum(count.sum(0))
        places = (np.cumsum(count, axis=0) - count)[::SPAN]
        states = np.stack(states[::-1], axis=1)
        return [
            (words[until[i] - count[:, i].sum() : until[i]].tobytes(), states[i].astype("<u8").tobytes(), places[:, i].astype("<u4").tobytes())
            for i in range(k)
        ]

    def decode(self, blocks: list[tuple[int, bytes, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of blocks given as (n, words, states, places)."""
        words = np.concatenate([np.frombuffer(w, dtype="<u4") for _, w, _, _ in blocks] + [np.zeros(1, dtype="<u4")]).astype(np.uint64)
        base = np.cumsum([0] + [len(w) // 4 for _, w, _, _ in blocks])
        spots = [np.frombuffer(p, dtype="<u4").astype(np.int64) + b for (_, _, _, p), b in zip(blocks, base[:-1], strict=True)]
        state = np.concatenate([np.frombuffer(s, dtype="<u8").reshape(-1, LANES) for _, _, s, _ in blocks])
        place = np.concatenate(spots)
        left = np.concatenate([np.minimum(SPAN * LANES, n - SPAN * LANES * np.arange(len(p))) for (n, _, _, _), p in zip(blocks, spots, strict=True)])
        parts = [self.stretches(words, state[i : i + STRETCHES], place[i : i + STRETCHES], left[i : i + STRETCHES]) for i in range(0, len(place), STRETCHES)]
        flat = np.concatenate([p[i, : left[j + i]] for p, j in zip(parts, range(0, len(place), STRETCHES), strict=True) for i in range(len(p))])
        return np.split(flat, np.cumsum([n for n, _, _, _ in blocks])[:-1])

    def stretches(self, words: np.ndarray, state: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The ids after each checkpoint, one row for each."""
        place, lane = place.copy(), np.arange(LANES)
        steps = -(-int(left.max()) // LANES)
        out = np.empty((len(state), steps, LANES), dtype=np.uint32)
        even = left.min() == left.max() and left.max() % LANES == 0
        low = np.uint64((1 << BITS) - 1)
        for t in range(steps):
            slot = state & low
            ids = self.symbol[slot]
            out[:, t] = ids
            state = self.freq[ids] * (state >> SHIFT) + slot - self.start[ids]
            need = state < LOW
            if not even:
                need &= t * LANES + lane < left[:, None]
            rank = np.cumsum(need, axis=1)
            at = np.minimum(place[:, None] + rank - 1, len(words) - 1)
            state = np.where(need, state << WORD | words[at], state)
            place += rank[:, -1]
        return out.reshape(len(state), -1)


# -- checksums of joined parts ------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32, highest power in the lowest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def crc_before(crc: int, n: int) -> int:
    """What a part with this crc32 adds, by exclusive or, to the crc32 of a whole in which n bytes follow it."""
    power, square = 1 << 31, 1 << 23  # x to the power of 0 and of 8
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(crc, power)


# -- files --------------------------------------------------------------------------------------


class BlockBuilder:
    """Lays the documents of one shard end to end and codes full blocks, several at a time."""

    def __init__(self, coder: Coder, shard: int):
        self.coder, self.shard = coder, shard
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.held = self.number = self.block = 0

    def add(self, key, ids: np.ndarray) -> Iterator[dict]:
        at = 0
        while at < len(ids):
            # a long document fills block after block; no more than TOGETHER of them are held
            part = ids[at : at + TOGETHER * BLOCK - self.held]
            self.docs.append((self.number, key, self.held, len(part), at, len(ids)))
            self.ids.append(part)
            self.held += len(part)
            at += len(part)
            if self.held == TOGETHER * BLOCK:
                yield from self.flush()
        self.number += 1

    def flush(self) -> Iterator[dict]:
        row = np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.int64)
        whole = len(row) // BLOCK
        coded = self.coder.encode(row[: whole * BLOCK].reshape(whole, BLOCK)) if whole else []
        if len(row) % BLOCK:
            coded += self.coder.encode(row[whole * BLOCK :][None, :])
        docs = iter(self.docs)
        doc = next(docs, None)
        for i, (words, states, places) in enumerate(coded):
            begin, end = i * BLOCK, min((i + 1) * BLOCK, len(row))
            inside = []
            while doc is not None and doc[2] < end:
                number, key, at, n, before, total = doc
                a, b = max(at, begin), min(at + n, end)
                inside.append({"number": number, "id": key, "at": a - begin, "n": b - a, "before": before + a - at, "total": total})
                if at + n > end:
                    break
                doc = next(docs, None)
            yield {
                "shard": self.shard, "block": self.block, "first": self.block * BLOCK, "n": end - begin,
                "words": words, "states": states, "places": places, "words_crc": zlib.crc32(words),
                "ids_crc": zlib.crc32(row[begin:end].astype("<u4").tobytes()), "docs": inside,
            }
            self.block += 1
        self.ids, self.docs, self.held = [], [], 0


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write its ids, and the end id, in ascending order of ``key``.

    Rows without a key come first, rows that repeat a key lie together in an order of their own, and
    each is a document. Null and empty texts have the end id only. Other columns, whatever their
    names, are not read. An empty table gives files without blocks. The order is dealt out by ranges
    of the key and of a hash of the ids, so that a key of very many rows is split too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    coded = token_ids(docs.select(docs[key].alias("k"), docs[text].alias("t")), tokenizer, end, "t", ("k",))
    ids = scratch.keep(coded.withColumn("row", F.monotonically_increasing_id()))
    kind = encoder(tokenizer).kind
    # as many rows as the vocabulary has ids
    table = frequencies({r["id"]: r["n"] for r in id_counts(ids, kind).collect()})
    spark.createDataFrame(sorted(table.items()), "id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    schema = T.StructType.fromDDL(BLOCKS.format(id=ids.schema["k"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        builder = BlockBuilder(Coder(table), TaskContext.get().partitionId())
        made = lambda rows: pa.RecordBatch.from_pylist(rows, schema=arrow)
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1), strict=True):
                if rows := list(builder.add(k.as_py(), np.frombuffer(v.as_buffer(), dtype=kind))):
                    yield made(rows)
        if rows := list(builder.flush()):
            yield made(rows)

    order = [F.col("k").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("k", "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    scratch.drop(ids)


def decode_blocks(spark: SparkSession, path: str, use: Callable[[dict, np.ndarray], list[dict]], schema: T.StructType) -> DataFrame:
    """``use(block row, its ids)`` over every block of a file set, as rows of ``schema``.

    A block whose words or ids don't agree with their checksums is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # as many rows as the vocabulary has ids
    table = {r["id"]: r["freq"] for r in spark.read.parquet(f"{path}/table").collect()}
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                for r in rows:
                    if zlib.crc32(r["words"]) != r["words_crc"]:
                        raise ValueError(f"damaged words in shard {r['shard']}, block {r['block']}")
                found = coder.decode([(r["n"], r["words"], r["states"], r["places"]) for r in rows])
                out = []
                for r, ids in zip(rows, found, strict=True):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != r["ids_crc"]:
                        raise ValueError(f"damaged ids in shard {r['shard']}, block {r['block']}")
                    out += use(r, ids)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start): ids in all shards before it. One row for each task that wrote, summed on the driver."""
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    starts = np.cumsum([0] + [r["n"] for r in sums]).tolist()
    return spark.createDataFrame([(r["shard"], s) for r, s in zip(sums, starts, strict=False)], "shard int, start bigint")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded blocks.

    The parts of a document that lies in several blocks are never gathered: each gives its share of
    the checksum of the whole, and shares are joined by exclusive or.
    """
    kind = spark.read.parquet(f"{path}/blocks").schema["docs"].dataType.elementType["id"].dataType

    def parts(row: dict, ids: np.ndarray) -> list[dict]:
        raw = memoryview(ids.astype("<u4").tobytes())
        out = []
        for d in row["docs"]:
            crc = zlib.crc32(raw[4 * d["at"] : 4 * (d["at"] + d["n"])])
            rest = d["total"] - d["before"] - d["n"]
            out.append({"shard": row["shard"], "number": d["number"], "doc_id": d["id"], "at": row["first"] + d["at"], "n": d["n"], "crc": crc_before(crc, 4 * rest) if rest else crc})
        return out

    schema = T.StructType.fromDDL(f"shard int, number bigint, doc_id {kind.simpleString()}, at bigint, n bigint, crc bigint")
    whole = decode_blocks(spark, path, parts, schema).groupBy("shard", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    placed = whole.join(shard_starts(spark, path), "shard")
    return placed.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, number, doc_id, part, ids): the ids of each document; ``part`` counts its ids in earlier blocks."""
    kind = spark.read.parquet(f"{path}/blocks").schema["docs"].dataType.elementType["id"].dataType

    def parts(row: dict, ids: np.ndarray) -> list[dict]:
        return [{"shard": row["shard"], "number": d["number"], "doc_id": d["id"], "part": d["before"], "ids": ids[d["at"] : d["at"] + d["n"]].tolist()} for d in row["docs"]]

    return decode_blocks(spark, path, parts, T.StructType.fromDDL(f"shard int, number bigint, doc_id {kind.simpleString()}, part bigint, ids array<bigint>"))


def token_file_digests(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` to files at ``path`` (a folder of the shared scratch if none) and read them back."""
    spark = docs.sparkSession
    where = path or Scratch(spark, "files").base
    write_tokens(docs, tokenizer, where, end)
    return read_digests(spark, where)
