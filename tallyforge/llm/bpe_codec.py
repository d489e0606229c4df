"""BPE encoding and decoding with forced boundaries.

A word is a sequence of bytes. A byte pair that occurs inside no vocabulary token can never be
joined by a merge, whatever the order of merges, so the place between its two bytes is a certain
cut: both sides are encoded on their own and their ids concatenated. Fragments repeat far more
often than words do, and a bounded table keeps the ids of those already met.

Text rules follow the tokenizer file: special strings in a text are cut out first and give their
own id; the rest is put in Unicode form NFC, letters become lower case one character at a time,
and the split pattern yields words. White space belongs to no word, so runs of it need no change,
and text may first be taken apart at spaces and line feeds.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Chunks and fragments remembered by one task at most, in each of three tables; a table is emptied when full.
MEMORY_ENTRIES = 120_000
#: Longer words are not remembered, so that the table's size is bounded in bytes too.
MEMORY_WORD_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Bytes that print as one visible Latin-1 character stand for themselves; the rest are numbered
    from U+0100 on, in order of byte value.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id << 20 | right id -> rank << 20 | id of the joined token
        self.merge: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            self.merge[self.vocab[left] << 20 | self.vocab[right]] = rank << 20 | self.vocab[left + right]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        inside = bytearray(65536)
        for token in self.vocab:
            bare = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            row = [value[c] for c in bare]
            for a, b in zip(row, row[1:], strict=False):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.fragments: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})

    # -- encoding -------------------------------------------------------------------------

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between certain cuts."""
        inside = self.inside
        places = [i for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if not inside[a << 8 | b]]
        if not places:
            return [word]
        return [word[a:b] for a, b in zip([0, *places], [*places, len(word)], strict=True)]

    def merge_fragment(self, fragment: bytes, ends: bool) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is joined first, the leftmost on ties."""
        ids = [self.inner[b] for b in fragment]
        if ends:
            ids[-1] = self.last[fragment[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        look, never = self.merge.get, 1 << 62
        offers = [look(a << 20 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while offers:
            best = min(offers)
            if best == never:
                break
            at = offers.index(best)
            new = best & 0xFFFFF
            ids[at : at + 2] = [new]
            del offers[at]
            if at < len(offers):
                offers[at] = look(new << 20 | ids[at + 1], never)
            if at:
                offers[at - 1] = look(ids[at - 1] << 20 | new, never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for fragments of any length."""
        import heapq

        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := self.merge.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (found >> 20, i, ids[i], ids[j], found & 0xFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        parts = self.cuts(word.encode("utf-8"))
        return b"".join([self.fragment(p, False) for p in parts[:-1]]) + self.fragment(parts[-1], True)

    def fragment(self, part: bytes, ends: bool) -> bytes:
        table = self.fragments[ends]
        found = table.get(part)
        if found is None:
            found = array("I", self.merge_fragment(part, ends)).tobytes()
            if len(part) <= MEMORY_WORD_CHARS:
                if len(table) >= MEMORY_ENTRIES:
                    table.clear()
                table[part] = found
        return found

    def normalize(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # one character at a time: a capital sigma does not depend on its place in the word
        return text.replace("Σ", "σ").lower()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        known = self.known
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if not part:
                continue
            for chunk in self.normalize(part).replace("\n", " ").split(" "):
                found = known.get(chunk)
                if found is None:
                    found = b"".join(map(self.encode_word, self.words(chunk)))
                    if len(chunk) <= MEMORY_WORD_CHARS:
                        if len(known) >= MEMORY_ENTRIES:
                            known.clear()
                        known[chunk] = found
                out.append(found)
        return b"".join(out)

    # -- decoding -------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as a file without a decoder asks for; unknown ids are left out."""
        tokens = self.tokens
        row = array("I")
        row.frombytes(ids)
        try:
            return " ".join([tokens[i] for i in row])
        except KeyError:
            return " ".join([tokens[i] for i in row if i in tokens])


def encode(df: DataFrame, tokenizer: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """``carry`` and ``out``: the ids of each text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give an empty value, never null. One row comes out for each row that goes
    in, repeated rows included. Texts of any length are encoded whole.
    """
    from tallyforge.llm.arrowtext import map_column

    def make():
        codec = BpeCodec(tokenizer)
        return lambda texts: [pa.array([codec.encode(t) if t else b"" for t in texts], pa.binary())]

    return map_column(df, text, T.StructType([T.StructField(out, T.BinaryType())]), make, list(carry))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id", "ids"), out: str = "decoded") -> DataFrame:
    """``carry`` and ``out``: the text of packed ids. Null and empty ids give an empty text."""
    from tallyforge.llm.arrowtext import map_column

    def make():
        codec = BpeCodec(tokenizer)
        return lambda rows: [pa.array([codec.decode(r) if r else "" for r in rows], pa.string())]

    return map_column(df, ids, T.StructType([T.StructField(out, T.StringType())]), make, list(carry))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``: ``carry``, ``ids`` and the text ``out`` that these ids give, by one codec and worker a task."""
    from tallyforge.llm.arrowtext import map_column

    def make():
        codec = BpeCodec(tokenizer)

        def both(texts: list) -> list[pa.Array]:
            coded = [codec.encode(t) if t else b"" for t in texts]
            return [pa.array(coded, pa.binary()), pa.array([codec.decode(r) if r else "" for r in coded], pa.string())]

        return both

    return map_column(df, text, T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())]), make, list(carry))


def id_array(ids: str = "ids"):
    """Column: packed ids as an array of longs, for callers that want them unpacked."""
    raw = F.hex(ids)
    at = F.sequence(F.lit(0), (F.length(raw) / 8).cast("int") - 1)
    flip = lambda i: F.concat(*[F.substring(raw, i * 8 + 1 + k, F.lit(2)) for k in (6, 4, 2, 0)])
    empty = F.array().cast("array<bigint>")
    return F.when(F.length(raw) >= 8, F.transform(at, lambda i: F.conv(flip(i), 16, 10).cast("bigint"))).otherwise(empty)
