"""Quality scores by co-training a text-content and a metadata classifier.

Both are logistic models. The content view of a document holds the shares of its words in hashed
buckets and a few shares of letters and lines, the metadata view its language, source and stated
length. In every round both models score all unlabelled documents; the rows that each is most sure
of are labelled by it, and the other learns from them. At the end each view is calibrated on labelled
rows that it wasn't fitted on (a logistic map of its margin), and the mean of both calibrated margins
scores every document.

Texts are read once, for a table of word counts and shapes by document. All rounds read that table,
and only ids and scores meet the labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.arrowtext import release
from tallyforge.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """``labelled`` bounds the labelled rows that the models are fitted and calibrated on.

    Of them a share of ``calibrated`` is for calibration only. Each round labels the ``exchanged``
    unlabelled documents that a model is most sure of, of each class, from all of them.
    """

    labelled: int = 2000
    calibrated: float = 0.25
    rounds: int = 2
    exchanged: int = 50
    sure: float = 0.95


BUCKETS, SHAPES, PAGE = 256, 9, 40


class ContentView:
    """Views of whole texts, some at a time; what is known of a word is kept while its task runs."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.facts = np.zeros((0, 6))
        # letter, capital, digit of each character of the first plane; later ones are none of these
        self.kinds = np.array([(c.isalpha(), c.isupper(), c.isdigit()) for c in map(chr, range(1 << 16))] + [(False, False, False)], dtype=np.float64)

    def facts_of(self, words: list[str]) -> np.ndarray:
        """Numbers of words, whose bucket, letters, capitals, digits, length, and whether all letters are capitals are in ``facts``."""
        known = self.known
        fresh = set(words).difference(known)
        if fresh:
            known.update(zip(list(fresh), range(len(known), len(known) + len(fresh)), strict=True))
            order = list(fresh)
            size = np.array([len(w) for w in order])
            code = np.minimum(np.frombuffer("".join(order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(self.kinds) - 1)
            kinds = np.add.reduceat(self.kinds[code], np.cumsum(size) - size)
            bucket = np.array([crc32(w.lower().encode("utf-8", "surrogatepass")) for w in order]) % BUCKETS
            rows = np.column_stack([bucket, kinds, size, (kinds[:, 1] > 0) & (kinds[:, 1] == kinds[:, 0])])
            first, last = len(known) - len(fresh), len(known)
            if last > len(self.facts):
                self.facts = np.vstack([self.facts[:first], np.zeros((last + len(self.facts), 6))])
            self.facts[first:last] = rows
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words by bucket, and the shapes."""
        if len(self.known) > 300_000:
            self.known.clear()
        split = [t.split() if t else [] for t in texts]
        count = np.array([len(w) for w in split])
        ids, owner = self.facts_of([w for words in split for w in words]), np.repeat(np.arange(len(texts)), count)
        facts, n = self.facts[ids], np.maximum(count, 1)
        bags = np.bincount(owner * BUCKETS + facts[:, 0].astype(np.int64), minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
        letters, upper, digits, size, shouted = (np.bincount(owner, facts[:, k], len(texts)) for k in range(1, 6))
        unlike = np.bincount(np.unique(owner * (len(self.known) + 1) + ids) // (len(self.known) + 1), minlength=len(texts))
        c = np.array([max(len(t or ""), 1) for t in texts])
        lines = [(t or "").split("\n") for t in texts]
        alike = np.array([len(set(x)) / len(x) for x in lines])
        shapes = [np.log1p(count), unlike / n, letters / c, upper / c, digits / c, (size - letters - digits) / c, alike, np.minimum(letters / n, 20.0), shouted / n]
        return bags, np.stack(shapes, 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return content_view(*self.counts(texts))


def content_view(bags: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the words, and the shapes."""
    return np.hstack([np.sqrt(bags / np.maximum(bags.sum(1), 1)[:, None]), shapes])


def metadata_codes(lang: str | None, source: str | None, n_chars) -> tuple[int, int, float]:
    """The flags of language and source, and the logarithm of the stated length."""
    return crc32(str(lang).encode()) % 8, 8 + crc32(str(source).encode()) % 31, float(np.log1p(max(0, n_chars))) if n_chars is not None and n_chars == n_chars else 0.0


def metadata_views(langs: np.ndarray, sources: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Language and source as hashed flags, and the stated length."""
    at, rows = np.arange(len(sizes)), np.zeros((len(sizes), PAGE))
    rows[at, langs] = 1.0
    rows[at, sources] = 1.0
    rows[:, PAGE - 1] = sizes
    return rows


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3, steps: int = 400) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (p - y) / len(y) + weight * w)
    return w


class Model:
    """One view: standardised logistic weights, and a calibration of their margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale, self.x, self.y = x.mean(0), x.std(0) + 1e-2, x, y
        self.calibration = np.array([1.0, 0.0])
        self.fit()

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def fit(self) -> None:
        self.weights = logistic(self.ready(self.x), self.y, 1e-2)

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = np.vstack([self.x, x]), np.append(self.y, y)
        self.fit()

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.ready(x) @ self.weights, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        m = self.margin(x)
        self.calibration = logistic(np.stack([m, np.ones(len(m))], 1), y)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) * self.calibration[0] + self.calibration[1]

    def light(self) -> Model:
        """Without its training rows, to be sent to tasks."""
        out = Model.__new__(Model)
        out.mean, out.scale, out.weights, out.calibration = self.mean, self.scale, self.weights, self.calibration
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: A row's counts are of 2 bytes each, or of 4 where one is too large.
VIEWS = "doc_id bigint, bags binary, shapes binary, lang int, source int, size double"


def stored_views(docs: DataFrame) -> DataFrame:
    """Both views of every row, some hundred bytes each."""

    def run(batches):
        content = ContentView()
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                doc_id, text, lang, source, n_chars = part.columns
                bags, shapes = content.counts(text.to_pylist())
                wide = bags.max(1) > 0xFFFF
                codes = list(zip(*map(metadata_codes, lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()), strict=True))
                made = [
                    pa.array([row.astype("<u4" if w else "<u2").tobytes() for row, w in zip(bags, wide, strict=True)], pa.binary()),
                    pa.array([row.astype("<f8").tobytes() for row in shapes], pa.binary()),
                    *(pa.array(x, kind) for x, kind in zip(codes, (pa.int32(), pa.int32(), pa.float64()), strict=True)),
                ]
                yield pa.RecordBatch.from_arrays([doc_id, *made], names=["doc_id", "bags", "shapes", "lang", "source", "size"])
        release()

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, VIEWS)


def mapped(stored: DataFrame, make, schema: str) -> DataFrame:
    """``make(ids, content view, metadata view)`` of 100 rows at a time: columns that follow the id."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                bags = [np.frombuffer(x, dtype="<u4" if len(x) == 4 * BUCKETS else "<u2") for x in part.column("bags").to_pylist()]
                a = content_view(np.array(bags, dtype=np.int64), np.frombuffer(b"".join(part.column("shapes").to_pylist()), dtype="<f8").reshape(-1, SHAPES))
                b = metadata_views(*(part.column(c).to_numpy() for c in ("lang", "source", "size")))
                found = make(a, b)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])
        release()

    return stored.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and the probability of good quality for every row.

    Null and empty texts and null metadata have views of their own and are scored like any others.
    Rows that repeat an id are scored one by one; of several labels of an id the higher counts, and
    of several labelled rows of an id one is learnt from. Labels whose crc32 of the id is divisible by
    5 are never learnt from. Without labels of both classes every score is 0.5. Ids are longs of any
    size. Only doc_id, text, lang, source and n_chars are read, whatever other columns there are.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", "n_chars")
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    scratch, seen = Scratch(docs.sparkSession, "quality"), set()
    stored = scratch.keep(stored_views(docs))
    key = F.xxhash64("doc_id")
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(key, "doc_id").limit(s.labelled)

    def gather(picked: DataFrame) -> pd.DataFrame:
        """Views of the few rows that ``picked`` names, by id."""
        rows = stored.join(F.broadcast(picked), "doc_id").toPandas()
        bags = [np.frombuffer(x, dtype="<u4" if len(x) == 4 * BUCKETS else "<u2") for x in rows["bags"]]
        shapes = [np.frombuffer(x, dtype="<f8") for x in rows["shapes"]]
        rows["id"] = rows["doc_id"]
        rows["content"] = list(content_view(np.array(bags, dtype=np.int64).reshape(-1, BUCKETS), np.array(shapes).reshape(-1, SHAPES)))
        rows["page"] = list(metadata_views(*(rows[c].to_numpy() for c in ("lang", "source", "size"))))
        rows["rank"] = [tuple(v) for v in rows["content"]]
        return rows.sort_values(["id", "rank"], kind="stable").drop_duplicates("id")

    stack = lambda f, c: np.array(f[c].to_list(), dtype=float).reshape(len(f), -1)
    known = gather(chosen.withColumn("quality", F.col("quality").cast("double")))
    apart = np.array([crc32(f"calibrate {i}".encode()) % 1000 < 1000 * s.calibrated for i in known["id"]], dtype=bool)
    y = known["quality"].to_numpy(float)
    models: list[Model] = []
    if len(set(y[~apart])) == 2:
        models = [Model(stack(known[~apart], c), y[~apart]) for c in ("content", "page")]
        told_of = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"))
        for _ in range(s.rounds):
            now = [m.light() for m in models]
            rate = lambda a, b, now=now: {"p0": sigmoid(now[0].margin(a)), "p1": sigmoid(now[1].margin(b))}
            rated = mapped(stored.where("doc_id is not null"), rate, "doc_id bigint, p0 double, p1 double")
            # a row that neither is sure of is never told
            rated = scratch.keep(rated.where((F.greatest("p0", "p1") >= s.sure) | (1 - F.least("p0", "p1") >= s.sure)).join(told_of, "doc_id", "left_anti"))
            told: list[dict[int, float]] = [{}, {}]
            for k in (0, 1):
                for label, sure in ((1.0, F.col(f"p{k}")), (0.0, 1 - F.col(f"p{k}"))):
                    # a sort with a limit: a few rows of each task
                    best = rated.where(sure >= s.sure).select("doc_id", sure.alias("sure")).orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id").limit(s.exchanged + len(seen)).collect()
                    fresh = [r.doc_id for r in best if r.doc_id not in seen][: s.exchanged]
                    told[1 - k].update((i, label) for i in fresh if i not in told[1 - k])
            scratch.drop(rated)
            named = sorted(set(told[0]) | set(told[1]))
            if not named:
                break
            seen.update(named)
            found = gather(docs.sparkSession.createDataFrame([(i, None) for i in named], "doc_id bigint, quality double")).set_index("id")
            for k, column in ((0, "content"), (1, "page")):
                ids = [i for i in told[k] if i in found.index]
                if ids:
                    models[k].learn(stack(found.loc[ids], column), np.array([told[k][i] for i in ids]))
        for m, column in zip(models, ("content", "page"), strict=True):
            if len(set(y[apart])) == 2:
                m.calibrate(stack(known[apart], column), y[apart])
    last = [m.light() for m in models]

    def score(a, b):
        return {"score": sigmoid((last[0].calibrated(a) + last[1].calibrated(b)) / 2) if last else np.full(len(a), 0.5)}

    return mapped(stored, score, "doc_id bigint, score double")
