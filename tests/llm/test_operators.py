"""Operators against the libraries they must equal and against brute force on small fixtures."""

import hashlib
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, "a b  c\n\nd", "word " * 700, "é" * 50, "<|endoftext|> The Ünï 12 don't!", "same text here for all", "same text here for all", "x" * 1500]


def frame(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", len(t or ""), "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long, ids string")


def test_token_counts(spark):
    import sentencepiece

    from tallyforge.llm.token_counts import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r[0]: r[1] for r in count_tokens(frame(spark), path).collect()}
    assert got == {i: len(lib.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert count_tokens(frame(spark).limit(0), path).count() == 0


def test_bpe_codec(spark):
    from tokenizers import Tokenizer

    from tallyforge.llm.bpe_codec import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in decode(encode(frame(spark), path), path).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_mixing(spark):
    from tallyforge.llm.mixing import mix_digest

    rows = mix_digest(frame(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: r["size"] for r in rows} == {i: len((t or "").split()) for i, t in enumerate(TEXTS)}
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, mix_digest(frame(spark)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_minhash(spark):
    from tallyforge.llm.minhash import Settings, near_duplicates

    rows = {r.doc_id: r for r in near_duplicates(frame(spark), Settings(words=4)).collect()}
    assert rows[7].component_id == 6 and not rows[7].kept and rows[6].kept
    assert all(rows[i].kept and rows[i].component_id == i for i in (0, 1, 2, 3, 4, 5))


def passages(seed):
    """Texts of shared, cut and repeated passages, with periodic stretches and copies."""
    import random

    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.randint(380, 900))) for _ in range(4)] + ["ab" * 260, "xyz " * 120]
    texts = []
    for _ in range(14):
        parts = []
        for _ in range(rng.randint(1, 4)):
            got = rng.choice(pool)
            parts.append(got[rng.randint(0, 40) : len(got) - rng.randint(0, 40)])
            parts.append("".join(rng.choice("pqrst") for _ in range(rng.randint(0, 60))))
        texts.append("".join(parts))
    return [*texts, texts[0], texts[1], texts[2] + "!", None, ""]


@pytest.mark.parametrize("texts", [TEXTS, passages(1), passages(2)])
def test_suffix(spark, texts):
    from tallyforge.llm.suffix_dedup import remove_repeats

    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    digests = {r.doc_id: r for r in remove_repeats(docs, digest=True).collect()}
    count = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 399):
            count[b[i : i + 400]] = count.get(b[i : i + 400], 0) + 1
    for i, t in enumerate(texts):
        b = (t or "").encode()
        start = [count[b[k : k + 400]] > 1 for k in range(len(b) - 399)]
        gone = [any(start[max(0, p - 399) : p + 1]) for p in range(len(b))]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(gone), spans, kept)
        assert digests[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert {r.doc_id for r in remove_repeats(docs, changed_only=True).collect()} == {i for i in got if got[i].n_removed}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_embeddings(spark):
    from tallyforge.llm.embed_dedup import near_duplicates

    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [2.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [float("nan"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (2, 1), 9: (0, 9)}


def test_html():
    from tallyforge.llm.html_extract import LABELLED, grow, main_text

    page = '<head><title>x</title></head><nav><a href=x>A</a></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>One <a href="q">two</a><br>three<div class="comments"><p>Nice!</p></div></article><footer>f</footer>'
    assert main_text(page, grow(LABELLED)) == "T & U\nOne two three"
    assert main_text(None, grow(LABELLED)) == ""


def test_toxicity_learns_subwords():
    from tallyforge.llm.toxicity import Settings, fit

    clean = [f"the cat number {i} sat on mat {i % 7}" for i in range(80)]
    toxic = [f"the moron number {i} sat on mat {i % 7}" for i in range(80)]
    model = fit(clean + toxic, [0] * 80 + [1] * 80, Settings())
    good, bad, misspelt = model.score(["the cat number 99 sat", "the moron number 99 sat", "the morron number 99 sat"])
    assert good < 0.5 < bad and misspelt > good
    assert 0 <= model.score([None])[0] <= 1
