"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of the word itself, a document the
mean of its words; a linear layer and softmax give the probability. Vectors and layer are trained
jointly in numpy. A misspelling that was never seen shares most n-grams with words that were.

Because everything between the table and the two logits is a mean, a document's logit difference
is the mean over its words of a number for each n-gram. Scoring therefore needs only one number
for each bucket, and whole texts of any length are scored in one pass.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Characters taken off both ends of a word.
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_`’“”«»…"


@dataclass(frozen=True)
class Settings:
    """``toxic_rows`` and ``clean_rows`` bound the sample of labelled rows that the model is fit on."""

    toxic_rows: int = 2000
    clean_rows: int = 3500
    buckets: int = 1 << 18
    width: int = 8
    shortest: int = 3
    longest: int = 8
    #: buckets whose log odds between the classes are closer to 0 than so many standard errors get no
    #: vector, so that the many rare words of a sample aren't learnt by heart
    least_z: float = 4.0
    #: the mean of hundreds of words moves little, so that it is scaled before the layer
    scale: float = 500.0
    epochs: int = 10
    batch: int = 32
    rate: float = 0.1
    seed: int = 7


def gram_buckets(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams and whole forms of words, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code))
    mix, rows, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    value = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, s.longest + 1):
        value = value * mix + np.append(code[n - 1 :], np.zeros(min(n - 1, len(code)), dtype=np.uint64))[: len(code)] + np.uint64(1)
        if n >= s.shortest:
            full = place + n <= end
            rows.append(_bucket(value[full] + np.uint64(n), s))
            owners.append(owner[full])
    first = np.cumsum(size) - size
    # a whole form is the sum of its letters, each scrambled with its place in the word
    scrambled = (code + np.uint64(1)) * mix ^ ((place - first[owner]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    scrambled ^= scrambled >> np.uint64(29)
    scrambled *= np.uint64(0xBF58476D1CE4E5B9)
    rows.append(_bucket(np.add.reduceat(scrambled, first), s))
    owners.append(np.arange(len(words)))
    ids, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=len(words))
    return ids[order], np.cumsum(count) - count


def _bucket(value: np.ndarray, s: Settings) -> np.ndarray:
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0x94D049BB133111EB)
    return ((value ^ (value >> np.uint64(31))) % np.uint64(s.buckets)).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def bare(word: str) -> str:
    return word.strip(EDGES) or word


@dataclass
class Model:
    settings: Settings
    #: logit difference (toxic less clean) that each bucket adds to the mean, and the bias
    table: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def word_values(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, start = gram_buckets([bare(w) for w in words], self.settings)
        count = np.diff(np.append(start, len(ids)))
        return np.add.reduceat(self.table[ids], start) / count

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, known = [words_of(t) for t in texts], self.known
        fresh = list(set().union(*rows).difference(known))
        known.update(zip(fresh, self.word_values(fresh).tolist(), strict=True))
        look = known.__getitem__
        mean = np.array([sum(map(look, r)) / len(r) if r else 0.0 for r in rows], dtype=np.float64)
        for w in fresh:
            if len(w) > 64:
                del known[w]
        if len(known) > 300_000:
            known.clear()
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -500, 500)))


def log_odds_z(met: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log odds ratio of being met in toxic and clean documents, in standard errors, for each bucket."""
    yes = met + 0.5
    no = docs[:, None] - met + 0.5
    return (np.log(yes[1] / no[1]) - np.log(yes[0] / no[0])) / np.sqrt((1 / yes + 1 / no).sum(0))


def fit(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Joint training of vectors and layer by AdaGrad on the softmax loss."""
    if not texts or len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1.0)
        return Model(s, np.zeros(s.buckets), float(np.log(share / (1 - share))))
    number: dict[str, int] = {}
    doc_words, doc_share = [], []
    for text in texts:
        bag = Counter(words_of(text))
        n = sum(bag.values())
        doc_words.append(np.array([number.setdefault(w, len(number)) for w in bag], dtype=np.int64))
        doc_share.append(np.array([c / n for c in bag.values()], dtype=np.float32))
    forms, found, sizes = [bare(w) for w in number], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(forms), 20_000):
        ids, first = gram_buckets(forms[at : at + 20_000], s)
        found.append(ids.astype(np.int32))
        sizes.append(np.diff(np.append(first, len(ids))))
    grams, count = np.concatenate(found), np.concatenate(sizes)
    start = np.cumsum(count) - count
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    layer = rng.normal(0, 0.1, (s.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(x.shape, 1e-6, np.float32) for x in (table, layer, bias)]
    y = np.eye(2, dtype=np.float32)[np.array(labels)]
    scale = np.float32(s.scale)
    met = np.zeros((2, s.buckets), np.int64)
    for words, label in zip(doc_words, labels, strict=True):
        n = count[words]
        first = np.cumsum(n) - n
        met[label, np.unique(grams[np.repeat(start[words] - first, n) + np.arange(n.sum())])] += 1
    useful = np.abs(log_odds_z(met, np.bincount(labels, minlength=2))) >= s.least_z
    table[~useful] = 0
    kept = useful[grams]
    full, word = count, np.repeat(np.arange(len(count)), count)[kept]
    grams, count = grams[kept], np.bincount(word, minlength=len(full))
    start = np.cumsum(count) - count
    for epoch in range(s.epochs):
        order = rng.permutation(len(texts))
        rate = s.rate * (1 - epoch / s.epochs)
        for at in range(0, len(order), s.batch):
            docs = order[at : at + s.batch]
            words = np.concatenate([doc_words[d] for d in docs])
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(docs)), [len(doc_words[d]) for d in docs])
            n = count[words]
            first = np.cumsum(n) - n
            ids = grams[np.repeat(start[words] - first, n) + np.arange(n.sum())]
            weight = np.repeat(np.concatenate([doc_share[d] for d in docs]) / full[words], n).astype(np.float32) * scale
            owner = np.repeat(doc, n)
            bag = np.stack([np.bincount(owner, weight * table[ids, k], minlength=len(docs)) for k in range(s.width)], 1).astype(np.float32)
            z = bag @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - y[docs]) / len(docs)
            back = dz @ layer.T
            used, inverse = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(inverse, weight * back[owner, k], minlength=len(used)) for k in range(s.width)], 1).astype(np.float32)
            seen[0][used] += step * step
            table[used] -= rate * step / np.sqrt(seen[0][used])
            for x, g, a in ((layer, bag.T @ dz, seen[1]), (bias, dz.sum(0), seen[2])):
                a += g * g
                x -= rate * 0.3 * g / np.sqrt(a)
    across = (layer[:, 1] - layer[:, 0]).astype(np.float64)
    return Model(s, (table.astype(np.float64) @ across) * float(scale), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Column: whether labels of this row must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, toxic) of at most ``toxic_rows`` + ``clean_rows`` labelled rows that may be learnt from.

    The rows with the smallest hashes of their ids are taken from each class, so that reruns agree.
    Ids are chosen from the labels alone and joined to the documents; the chosen ids are few by
    those two bounds, whatever the size of the tables.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    chosen = usable.where("toxic = 1").orderBy(key, "doc_id").limit(s.toxic_rows).unionByName(usable.where("toxic = 0").orderBy(key, "doc_id").limit(s.clean_rows))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    rows = labelled_sample(docs, labels, s).toPandas().sort_values("doc_id", kind="stable")
    rows = rows.drop_duplicates("doc_id")
    return fit(rows["text"].where(rows["text"].notna(), None).tolist(), rows["toxic"].tolist(), s)


def score(df: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``carry`` and the probability that each whole text is toxic.

    Null and empty texts get the probability that the bias alone gives. Repeated rows each give a
    row with the same score. Only ``text`` is looked at.
    """
    from tallyforge.llm.arrowtext import map_column

    settings, table, bias = model.settings, model.table.astype(np.float32), model.bias

    def make():
        own = Model(settings, table, bias)
        return lambda texts: [pa.array(own.score(texts), pa.float64())]

    return map_column(df, text, T.StructType([T.StructField(out, T.DoubleType())]), make, list(carry))
