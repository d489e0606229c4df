"""Removal of repeated byte strings by distributed prefix doubling over position rank pairs.

Spark ranks positions at growing lengths and drops those that are unique at each:

1. 64 bytes. Of every 400-byte string only the position of its lowest 64-byte string counts (its
   anchor): equal strings have equal anchors at equal distances, so strings whose anchor is unique
   are unique. The starts that share an anchor form blocks of ``SIZES[0]``, cut at fixed distances
   from it, so that equal strings fall into equal blocks.
2. The pair (rank of 256 bytes, rank of 256 bytes at an offset) over the 289 bytes that all strings
   of a block share. Blocks that are unique there are dropped. The pair over the 511 bytes that a
   block spans is past the threshold: where it repeats, all strings of the block repeat.
3. Blocks that are neither are cut into blocks of ``SIZES[1]``, whose pairs cover 387 and 413 bytes.
4. What is left is ranked start by start by the pair that covers 400 bytes.

One copy of each repeated block goes on as a witness while blocks that share its inner bytes are
still open. Ranks of up to 256 bytes are doubled inside a document (2, 4, ... 256 bytes) as 64-bit
fingerprints. Equal pairs of fingerprints are taken for equal strings: two given unlike strings
agree with a probability of about 2e-38.

These are the figures of ``LONG``; ``SHORT`` is the same plan for 200 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.arrowtext import release
from tallyforge.llm.scratch import Scratch

LENGTH, ANCHOR, HALF = 400, 64, 256
#: Starts a block in each round. Each size divides the one before.
SIZES = (112, 14, 1)
#: Positions that are hashed at once, whatever the length of a text.
CHUNK = 1 << 16
WINDOW = LENGTH - ANCHOR + 1


@dataclass(frozen=True)
class Scale:
    """The least ``length`` of a repeat, the bytes of an anchor and of a rank, and the starts a block in each round.

    For each size the bytes that a block's strings share (``length`` - size + 1) are at least ``half``, and
    those that it spans (``length`` + size - 1) at most twice that.
    """

    length: int = LENGTH
    anchor: int = ANCHOR
    half: int = HALF
    sizes: tuple[int, ...] = SIZES


LONG, SHORT = Scale(), Scale(200, 64, 128, (56, 14, 1))


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the ``length`` (a power of two) bytes at every position."""
    row = data.astype(np.uint64) + np.uint64(1)
    row *= np.uint64(0xD6E8FEB86659FD93)
    row ^= row >> np.uint64(29)
    span = 1
    while span < length:
        row = row[:-span] * np.uint64(0x9E3779B97F4A7C15) + row[span:]
        row ^= row >> np.uint64(31)
        row *= np.uint64(0x94D049BB133111EB)
        span *= 2
    return row


def ranks(data: np.ndarray, positions: np.ndarray, half: int = HALF) -> np.ndarray:
    """The rank of ``half`` bytes at each of the sorted ``positions``."""
    if len(data) <= 2 * CHUNK:
        return doubled(data, half)[positions]
    out = np.empty(len(positions), dtype=np.uint64)
    for at in range(0, len(data) - half + 1, CHUNK):
        a, b = np.searchsorted(positions, [at, at + CHUNK])
        if b > a:
            out[a:b] = doubled(data[at : at + CHUNK + half - 1], half)[positions[a:b] - at]
    return out


class Anchors:
    """Anchors of whole texts, by a rolling hash: unlike strings that agree only make more candidates."""

    def __init__(self, scale: Scale = LONG):
        self.length, self.size, self.window = scale.length, scale.anchor, scale.length - scale.anchor + 1
        n, base = CHUNK + self.length, 0x9E3779B97F4A7C15
        self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, dtype=np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        self.byte = doubled(np.arange(256, dtype=np.uint8), 1)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=total[1:])
        row = total[self.size:] - total[:-self.size]
        row *= self.down[: len(row)]
        row ^= row >> np.uint64(32)
        row *= np.uint64(0xD6E8FEB86659FD93)
        row ^= row >> np.uint64(29)
        return row

    def part(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        row = self.hashes(data)
        low = _slide(np.minimum, row, self.window)
        edge = np.zeros(self.window - 1, dtype=np.uint64)
        places = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, low, edge]), self.window) == row)
        # runs of windows with one lowest value, and the places in each that hold it
        a = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        b = np.append(a[1:], len(low)) - 1
        values, rank = np.unique(row[places], return_inverse=True)
        wide = np.int64(1) << np.int64(40)
        code = np.sort(rank * wide + places)
        base = np.searchsorted(values, low[a]) * wide
        first, last = np.searchsorted(code, base + a), np.searchsorted(code, base + b)
        last = np.where((last < len(code)) & (code[np.minimum(last, len(code) - 1)] <= base + b + self.window - 1), last, last - 1)
        count = last - first + 1
        of = np.repeat(np.arange(len(a)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        q = code[first[of] + step] % wide
        lo = np.where(step == 0, a[of], np.append(0, q[:-1]) + 1)
        return q, lo, np.minimum(q, b[of]), row[q]

    def of(self, data: np.ndarray) -> list[np.ndarray]:
        """Anchor places, the first and last start that each is the anchor of, and 64-byte ranks."""
        windows, parts = len(data) - self.length + 1, []
        for at in range(0, windows, CHUNK):
            q, lo, hi, a = self.part(data[at : min(at + CHUNK, windows) + self.length - 1])
            parts.append((q + at, lo + at, hi + at, a))
        return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _slide(function, row: np.ndarray, width: int) -> np.ndarray:
    n, span = len(row) - width + 1, 1
    while span * 2 <= width:
        row = function(row[:-span], row[span:])
        span *= 2
    return function(row[:n], row[width - span : width - span + n])


def cut_blocks(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Blocks of ``size`` starts at fixed distances before ``q``, cut from the starts ``lo`` to ``hi``.

    A block is named by its last start. Each is returned once a text, however often it is met, with
    the hull of its starts, and as known to repeat if any of what it was cut from is.
    """
    low, high = (q - hi) // size, (q - lo) // size
    of = np.repeat(np.arange(len(q)), high - low + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
    core = q[of] - k * size
    a, b, w = np.maximum(lo[of], core - size + 1), np.minimum(hi[of], core), known[of]
    order = np.argsort(core, kind="stable")
    core = core[order]
    head = np.flatnonzero(np.append(True, core[1:] != core[:-1])[: len(core)])
    if not len(head):
        return core, core, core, known[:0]
    return core[head], np.minimum.reduceat(a[order], head), np.maximum.reduceat(b[order], head), np.logical_or.reduceat(w[order], head)


def block_pairs(data: np.ndarray, core: np.ndarray, size: int, scale: Scale = LONG) -> tuple[np.ndarray, ...]:
    """The rank pairs of the bytes shared by a block's strings and of those it spans; the mask of whole blocks."""
    wide = core - size + 1
    whole = (wide >= 0) & (core + scale.length <= len(data))
    inner, outer = scale.length - size + 1 - scale.half, scale.length + size - 1 - scale.half
    wanted = [core, core + inner, *((wide[whole], wide[whole] + outer) if size > 1 else ())]
    places, back = np.unique(np.concatenate(wanted), return_inverse=True)
    found = np.split(ranks(data, places, scale.half).view(np.int64)[back], np.cumsum([len(x) for x in wanted])[:-1])
    f0, f1 = np.zeros(len(core), np.int64), np.zeros(len(core), np.int64)
    if size > 1:
        f0[whole], f1[whole] = found[2:]
    return found[0], found[1], f0, f1, whole


def cover(n: int, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``n`` bytes are inside a repeated string that begins at ``first`` to ``last``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    return np.cumsum(edge)[:n] > 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Every row of batches whose column ``text`` is binary, with its bytes."""
    for batch in batches:
        texts = batch.column("text")
        for i in range(len(batch)):
            value = texts[i]
            yield batch, i, np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)


def _struct(value, names: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of a list of structs as arrays."""
    inner = value.values
    return [inner.field(inner.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*parts, parts[0][:0]])).cast(kind))


def _grouped(stream: Iterator, most: int = 200) -> Iterator[list]:
    group = []
    for x in stream:
        group.append(x)
        if len(group) == most:
            yield group
            group = []
    if group:
        yield group


def anchor_rows(scale: Scale = LONG):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Anchors(scale)
        for group in _grouped((b.column("id")[i].as_py(), b.column("w")[i].as_py(), make.of(data)) for b, i, data in _rows(batches)):
            ids, known, made = zip(*group, strict=True)
            columns = [_lists([m[k] for m in made], pa.int32()) for k in range(3)] + [_lists([m[3].view(np.int64) for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(known, pa.bool_()), *columns], names=["id", "w", "q", "lo", "hi", "a"])
        release()

    return run


def block_rows(size: int, scale: Scale = LONG):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch, i, data):
            q, lo, hi, w = _struct(batch.column("runs")[i], ("q", "lo", "hi", "w"))
            core, lo, hi, w = cut_blocks(*(x.astype(np.int64) for x in (q, lo, hi)), w.astype(bool), size)
            return batch.column("id")[i].as_py(), core, lo, hi, w, *block_pairs(data, core, size, scale)

        for group in _grouped((one(*row) for row in _rows(batches)), 50):
            ids, *made = zip(*group, strict=True)
            core, lo, hi, w, s0, s1, f0, f1, whole = (np.concatenate(x) for x in made)
            names = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in made[0]])
            key = pa.array(ids, pa.binary()).take(pa.array(names))
            yield pa.RecordBatch.from_arrays(
                [key, *(pa.array(x, pa.int32()) for x in (core, lo, hi)), pa.array(w), pa.array(s0), pa.array(s1), pa.array(f0, mask=~whole), pa.array(f1, mask=~whole)],
                names=["id", "core", "lo", "hi", "w", "s0", "s1", "f0", "f1"],
            )
        release()

    return run


def _weight():
    return F.sum(F.when(F.col("w"), 2).otherwise(1))


def remove_repeats(
    docs: DataFrame, text: str = "text", digest: bool = False, changed_only: bool = False, characters: bool = False, scale: Scale = LONG
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the bytes ``kept`` of each row's text.

    A null text is empty. Texts shorter than 400 bytes stay whole. Rows with equal texts, repeated
    rows included, are handled once and count as often as they occur; if such a text has 400 bytes,
    all of it goes. Matches never cross rows. Other columns of ``docs``, whatever their names, are
    not looked at. ``digest`` gives the lowercase SHA-256 ``kept_sha256`` in place of the bytes.
    ``changed_only`` leaves out rows that lose nothing. ``characters`` also removes the other bytes
    of characters that a cut divides. ``scale`` gives the length of the strings: 400 bytes unless said otherwise.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.substring(F.sha2(body, 256), 1, 32))
    # texts are dealt by key once and written in buckets; all later joins with them stay in place
    rows = scratch.keep(docs.select("doc_id", key.alias("id")))
    texts = docs.select(key.alias("id"), body.cast("binary").alias("text")).groupBy("id").agg((F.count("*") > 1).alias("w"), F.first("text").alias("text"))
    texts = scratch.keep_bucketed(texts, "id")
    long = texts.where(F.octet_length("text") >= scale.length)

    found = scratch.keep(long.mapInArrow(anchor_rows(scale), "id binary, w boolean, q array<int>, lo array<int>, hi array<int>, a array<bigint>"))
    again = found.select("w", F.explode("a").alias("a")).groupBy("a").agg(_weight().alias("n"), F.bool_and("w").alias("closed")).where("n > 1 and not closed").select("a")
    anchors = found.select("id", "w", F.explode(F.arrays_zip("q", "lo", "hi", "a")).alias("x")).select("id", "w", "x.*")
    left = anchors.join(again, "a").select("id", "q", "lo", "hi", "w")

    settled = []
    for size in scale.sizes:
        runs = left.groupBy("id").agg(F.collect_list(F.struct("q", "lo", "hi", "w")).alias("runs"))
        made = long.select("id", "text").join(runs.hint("shuffle_hash"), "id")
        ranked = scratch.keep(made.mapInArrow(block_rows(size, scale), "id binary, core int, lo int, hi int, w boolean, s0 bigint, s1 bigint, f0 bigint, f1 bigint"))
        if size == scale.sizes[0]:
            scratch.drop(found)
        shared = ranked.groupBy("s0", "s1").agg(_weight().alias("n"), F.bool_and("w").alias("closed")).where("n > 1 and not closed").select("s0", "s1")
        inner = ranked.join(shared, ["s0", "s1"])
        if size == 1:
            settled.append(inner.where("not w").select("id", F.col("core").alias("first"), F.col("core").alias("last")))
            break
        spanned = ranked.where("f0 is not null").groupBy("f0", "f1").agg(_weight().alias("n")).where("n > 1").select("f0", "f1", F.lit(True).alias("past"))
        state = inner.join(spanned, ["f0", "f1"], "left").withColumn("past", F.coalesce("past", F.lit(False)))
        state = scratch.keep(state.select("id", "core", "lo", "hi", "w", "s0", "s1", "f0", "f1", (F.col("past") | F.col("w")).alias("past")))
        scratch.drop(ranked)
        settled.append(state.where("past and not w").select("id", (F.col("core") - (size - 1)).alias("first"), F.col("core").alias("last")))
        unsettled = state.where("not past")
        # a known block that isn't whole stands for itself
        own = F.when(F.col("f0").isNull(), F.concat_ws(":", F.hex("id"), "core"))
        copy = state.where("past").groupBy("f0", "f1", own.alias("own")).agg(F.min(F.struct("id", "core", "lo", "hi", "s0", "s1")).alias("x")).select("x.*")
        copy = copy.join(unsettled.select("s0", "s1").distinct(), ["s0", "s1"], "left_semi")
        left = unsettled.select("id", F.col("core").alias("q"), "lo", "hi", "w").unionByName(copy.select("id", F.col("core").alias("q"), "lo", "hi", F.lit(True).alias("w")))
    starts = settled[0]
    for more in settled[1:]:
        starts = starts.unionByName(more)
    starts = starts.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    last = "kept_sha256" if digest else "kept"

    def cut(batches):
        def one(batch, i, data):
            n, runs = len(data), batch.column("runs")[i]
            if n >= scale.length and batch.column("w")[i].as_py():
                gone = np.ones(n, bool)
            elif runs.is_valid:
                gone = cover(n, *(x.astype(np.int64) for x in _struct(runs, ("first", "last"))), scale.length)
                if characters:
                    of = np.cumsum(data & 0xC0 != 0x80) - 1
                    gone = (np.bincount(of, gone) > 0)[of]
            else:
                gone = np.zeros(n, bool)
            kept = data[~gone].tobytes()
            spans = int((gone & ~np.append(False, gone[:-1])[:n]).sum())
            return batch.column("id")[i].as_py(), n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept

        for group in _grouped(one(*row) for row in _rows(batches)):
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*group, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", last])
        release()

    form = f"id binary, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}"
    wanted = texts.select("id", "w", "text").join(starts.hint("shuffle_hash"), "id", "left")
    if changed_only:
        wanted = wanted.where(F.col("runs").isNotNull() | F.col("w"))
    done = wanted.mapInArrow(cut, form)
    if changed_only:
        done = done.where("n_removed > 0")
    return rows.join(done, "id").drop("id")
