"""Token files against the tokenizers library, exact round trips, damage and odd tables."""

import zlib

import numpy as np
import pytest

from tallyforge.llm import token_files as tf
from tallyforge.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, k int"


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for r, ids in zip(rows, library([r[1] for r in rows]), strict=True):
        ids = [*ids, 2]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_as_whole_texts():
    texts = [
        "a  b\n\n c\t d \n", " lead", "trail  ", "\n \n", "it's they'll 's 12,34 ?! x", "a b  c\u0085 d", "x\x1cy \x1f z !\x1c", "<|endoftext|> a<|endoftext|>b  <|endo",
        "é" * 300 + " " * 70 + "z", "日本語 テスト　 x", "", None, "\r\n a\r\n\r\n b", " ".join("w%d" % (i % 97) for i in range(5000)), "\v\f a \v\f", "a​b ​ c", "﻿ a",
    ]
    encoder = tf.PieceEncoder(PATH)
    got = [np.frombuffer(x, dtype=encoder.kind).tolist() for x in encoder.encode(texts)]
    assert got == library(texts)
    assert encoder.encode(texts) == encoder.encode(texts)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 4096, tf.SPAN * tf.LANES, tf.SPAN * tf.LANES + 5, tf.BLOCK - 1])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 50257
    coder = tf.Coder(tf.frequencies({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)}))
    assert int(coder.freq.sum()) == 1 << tf.BITS
    coded = coder.encode(np.stack([ids, ids[::-1]]))
    a, b = coder.decode([(n, *coded[0]), (n, *coded[1])])
    assert (a == ids).all() and (b == ids[::-1]).all()


def test_decoding_begins_at_a_checkpoint():
    ids = np.random.default_rng(5).zipf(1.2, tf.BLOCK) % 1000
    coder = tf.Coder(tf.frequencies({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)}))
    [(words, states, places)] = coder.encode(ids[None, :])
    width = tf.SPAN * tf.LANES
    at = int(np.frombuffer(places, dtype="<u4")[2])
    one = coder.decode([(width, words[4 * at :], states[2 * 8 * tf.LANES : 3 * 8 * tf.LANES], np.zeros(1, "<u4").tobytes())])
    assert (one[0] == ids[2 * width : 3 * width]).all()
    assert len(words) < 4 * len(ids) * 0.6


@pytest.mark.parametrize("counts", [{}, {7: 5}, {1: 10**12, 2: 1}, {i: 1 for i in range(50257)}])
def test_frequencies(counts):
    found = tf.frequencies(counts)
    assert set(found) == set(counts) and all(v >= 1 for v in found.values())
    assert sum(found.values()) == (1 << tf.BITS if counts else 0)


def test_checksum_of_parts():
    raw = bytes(range(256)) * 9
    for cut in (0, 1, 100, len(raw) - 1):
        a, b = raw[:cut], raw[cut:]
        assert tf.crc_before(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(raw)


def test_documents(spark):
    long = " ".join(f"word{i * 7919 % 50021}" for i in range(120_000))
    rows = [(i, f"Text number {i} has words, it's {i % 7}." * (i % 5), "x", 1) for i in range(400)]
    rows += [(401, long, None, 2), (402, None, None, None), (403, "", None, 3), (-5, "<|endoftext|>", "y", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, tf.token_file_digests(df, PATH).collect()))
    assert got == sorted(expected(rows))
    assert max(r[2] for r in got) > 3 * tf.BLOCK


def test_repeated_and_missing_ids(spark):
    rows = [(None, "no id", None, 0), (None, "no id either", None, 0)] + [(3, "same", None, 0)] * 50 + [(3, "other", None, 0), (1, "one", None, 0)]
    got = sorted(map(tuple, tf.token_file_digests(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1] + [3] * 51
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert sorted(r[3] for r in got) == sorted(r[3] for r in expected(rows))


def test_empty_table(spark):
    assert tf.token_file_digests(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_ids_come_back_and_damage_is_found(spark, tmp_path):
    rows = [(i, f"some text {i} " * 20, None, 0) for i in range(30)]
    path = f"file://{tmp_path}/files"
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA), PATH, path, 2)
    back = {r["doc_id"]: r["ids"] for r in tf.read_tokens(spark, path).collect()}
    assert back == {r[0]: [*ids, 2] for r, ids in zip(rows, library([r[1] for r in rows]), strict=True)}
    from pyspark.sql import functions as F

    other = f"file://{tmp_path}/other"
    spark.read.parquet(f"{path}/table").write.parquet(f"{other}/table")
    bad = spark.read.parquet(f"{path}/blocks").withColumn("words", F.concat(F.substring("words", 1, 40), F.lit(b"\x01\x02\x03\x04"), F.expr("substring(words, 45)")))
    bad.write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="damaged words"):
        tf.read_digests(spark, other).collect()


def test_pieces_are_found_by_the_batch(monkeypatch):
    """Pieces as by the expression that says what they are, and no look at a piece that is met again."""
    import re

    import pyarrow as pa

    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    rule = re.compile(rf"\s*[{letters}]+(?=[.,;:!?\s]|\Z)|\s*\S+|\s+\Z").findall
    texts = ["", "a", " ", " a, b.c d", "é,b ×.a ÷, é÷. aé! x", "Ã, Ãb", ".a,", "a\n\n", "\t", "ab", "cd, ef", ",", "it's 12,3 ab?c!", "日本. é"]
    values = pa.array(texts, pa.large_string())
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[: ends[-1]]
    starts = tf.piece_starts(data, ends).tolist()
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] == [p for t in texts for p in rule(t)]
    encoder = tf.PieceEncoder(PATH)
    asked = []
    monkeypatch.setattr(encoder, "fresh", lambda pieces, real=encoder.fresh: (asked.extend(pieces), real(pieces))[1])
    first = encoder.encode(texts)
    assert len(asked) == len(set(asked)) and encoder.encode([*texts, *texts]) == first * 2
    assert len(asked) == len({p for t in texts for p in rule(t)})


def test_new_pieces_are_split_here_as_by_the_library(monkeypatch):
    """Words, digits and signs as the library splits them, without its splitting; it remembers no object for each piece."""
    import itertools

    import pyarrow as pa

    parts = ["ab", "é", "Ça", "12", "#", "--", "_", "'s", "'", "<|endoftext|>", "<", " ", "\n", "\t", "ª", "日", "×", "\x00", "x" * 70]
    texts = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.islice(itertools.product(parts, repeat=n), 0, None, 1 + 3 * (n == 4))]
    encoder = tf.PieceEncoder(PATH)
    assert [np.frombuffer(x, dtype=encoder.kind).tolist() for x in encoder.encode(texts)] == library(texts)
    assert isinstance(encoder.known, pa.Array) and len(encoder.known) == len(encoder.known_ids)
    # in Arrow, in the middle of an array and with null
    held = pa.array(["before", None, "", " été###", "after all"])
    asked = []
    other = tf.PieceEncoder(PATH)
    monkeypatch.setattr(other, "unsplit", lambda pieces, real=other.unsplit: (asked.extend(pieces), real(pieces))[1])
    assert [np.frombuffer(x, dtype=other.kind).tolist() for x in other.encode(held[1:])] == library([None, "", " été###", "after all"])
    assert asked == []
    # what is remembered is bounded, and ids stay the same when most of it is let go
    monkeypatch.setattr(tf, "MEMORY_ENTRIES", 50)
    for at in range(0, 600, 40):
        assert [np.frombuffer(x, dtype=other.kind).tolist() for x in other.encode(texts[at : at + 40])] == library(texts[at : at + 40])
        assert len(other.known) <= 50
