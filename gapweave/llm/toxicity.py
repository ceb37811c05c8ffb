"""Toxicity by a convolutional text classifier.

Words (runs of letters, lower case) are hashed to buckets with learned vectors, a word's own plus those of its beginnings and
its end, so that an inflected form is known by its stem; filters of several widths slide over the sequence,
each keeps its maximum over the whole text, and a logistic unit reads the maxima. Training starts in numpy on a bounded sample of
labelled documents. Where there are more, every labelled document is read: chunks of them go on from the common model inside tasks,
and what they changed is averaged by Spark. Words are dropped at random in training so that a document is not remembered by a rare word. The threshold is
calibrated for each language, as the language identifier reads it off the text, on all labelled documents that training did not see,
and folded into the score: 0.5 is the threshold. For scoring, vectors and filters fold into one table of filter
responses per bucket and place, and whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common, language
from gapweave.plans.storage import materialize

#: Labelled documents of a class with which training starts at most (whole texts), buckets, vector size, filter widths, filters of each.
SAMPLE, BITS, WIDTH, SIZES, FILTERS = 2000, 16, 16, (1, 2, 3), 8
#: Words read at a time, calibration documents with which a language's own threshold weighs as much as the common one.
PIECE, SHRINK = 1 << 16, 20
#: Times that all labelled documents are read after the start, documents of a chunk on average, rate of learning at first.
ROUNDS, CHUNK, RATE = 2, 4096, 0.02
#: Share of words that are read in training.
KEEP = 0.7
#: Changes are added up as whole multiples of 1 / UNIT, so no order of tasks shows; logits are counted in steps of 1 / STEPS, up to FAR.
UNIT, STEPS, FAR = 1 << 40, 256, 1 << 10
WORDS = re.compile(r"[^\W\d_]+")


#: Parts of a word that have a vector: all of it, beginnings, end.
PARTS = (lambda w: w, lambda w: "^" + w[:4], lambda w: "^" + w[:6], lambda w: w[-4:] + "$")
#: Words whose parts and responses a task remembers.
MEMO = 400_000


class Words(dict):
    """Number of a word, remembered with the buckets of its parts."""

    def __init__(self):
        super().__init__()
        self.parts, self.begun = np.zeros((1024, len(PARTS)), np.int32), 0
        self.fresh: list[int] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh += [zlib.crc32(f(word).encode("utf-8", "replace")) for f in PARTS]
        return n

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words; they hold until the next call."""
        if len(self) > MEMO:
            self.clear()
            self.begun += 1
        w = WORDS.findall((text or "").lower())
        out = np.fromiter(map(self.__getitem__, w), dtype=np.int32, count=len(w))
        if self.fresh:
            new = (np.array(self.fresh, dtype=np.int64) >> (32 - BITS)).astype(np.int32).reshape(-1, len(PARTS))
            self.fresh, n = [], len(self)
            if n > len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros((max(n - len(self.parts), len(self.parts)), len(PARTS)), np.int32)])
            self.parts[n - len(new) : n] = new
        return out


class ToxicityModel:
    """Vectors, filters and output of the network; thresholds by language."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
        self.f = [rng.normal(0, 0.3, (k, WIDTH, FILTERS)).astype(np.float32) for k in SIZES]
        self.c = np.zeros((len(SIZES), FILTERS), np.float32)
        self.w = rng.normal(0, 0.3, len(SIZES) * FILTERS).astype(np.float32)
        self.b = np.float32(-1.0)
        self.threshold: dict[str, float] = {}
        self.common, self.scale, self.languages = 0.0, 1.0, None

    def forward(self, ids: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Logit, maxima and their places of a text given as buckets (words x parts), padded behind."""
        x = np.concatenate([self.e[ids].sum(axis=1), np.zeros((max(SIZES) - 1, WIDTH), np.float32)])
        top, at = np.zeros((len(SIZES), FILTERS), np.float32), np.full((len(SIZES), FILTERS), -1)
        for r, (k, f) in enumerate(zip(SIZES, self.f, strict=True)):
            m = len(x) - k + 1
            y = sum(x[j : j + m] @ f[j] for j in range(k)) + self.c[r]
            at[r] = y.argmax(axis=0)
            top[r] = np.maximum(y.max(axis=0), 0)
        return float(top.ravel() @ self.w + self.b), top, at

    def step(self, ids: np.ndarray, y: int, rate: float, weight: float) -> None:
        z, top, at = self.forward(ids)
        d = np.float32(weight * (1 / (1 + np.exp(-z)) - y))
        g = (d * self.w).reshape(top.shape)
        self.w -= rate * d * top.ravel()
        self.b -= rate * d
        for r, k in enumerate(SIZES):
            q = np.flatnonzero(top[r] > 0)
            self.c[r, q] -= rate * g[r, q]
            for j in range(k):
                at_j = at[r, q] + j
                live, words = q[at_j < len(ids)], ids[at_j[at_j < len(ids)]]
                gq, v = rate * g[r, live], self.e[words].sum(axis=1)
                np.subtract.at(self.e, words, (3 * gq[:, None] * self.f[r][j, :, live])[:, None, :])
                self.f[r][j, :, live] -= gq[:, None] * v

    def flat(self) -> np.ndarray:
        """All parameters as rows of ``WIDTH`` numbers: the vectors, then the rest."""
        rest = np.concatenate([*[f.ravel() for f in self.f], self.c.ravel(), self.w, [self.b]]).astype(np.float32)
        return np.concatenate([self.e, np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)])

    def load(self, flat: np.ndarray) -> None:
        """Parameters from rows as ``flat`` gives them."""
        self.e, rest, at = flat[: len(self.e)].copy(), flat[len(self.e) :].ravel(), 0
        for k, f in enumerate(self.f):
            self.f[k], at = rest[at : at + f.size].reshape(f.shape).copy(), at + f.size
        self.c, at = rest[at : at + self.c.size].reshape(self.c.shape).copy(), at + self.c.size
        self.w, self.b = rest[at : at + self.w.size].copy(), rest[at + self.w.size]

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Answer of every filter and place to words given by their parts (words x parts), one column each."""
        return self.e[parts].sum(axis=1) @ np.concatenate([f[j] for f in self.f for j in range(len(f))], axis=1)

    def logit(self, table: np.ndarray, words: np.ndarray) -> float:
        """Logit of a text of any length: rows ``words`` of the responses; a last row of ``table`` is the padding."""
        top = np.zeros((len(SIZES), FILTERS), np.float32)
        words = np.concatenate([words, np.full(max(SIZES) - 1, -1, np.int32)])
        for lo in range(0, len(words), PIECE):
            part = table[words[lo : lo + PIECE + max(SIZES) - 1]]
            place = 0
            for r, k in enumerate(SIZES):
                if (m := len(part) - k + 1) > 0:
                    y = part[:m, place : place + FILTERS]
                    for j in range(1, k):
                        y = y + part[j : j + m, place + j * FILTERS : place + (j + 1) * FILTERS]
                    top[r] = np.maximum(top[r], y.max(axis=0) + self.c[r])
                place += k * FILTERS
        return float(top.ravel() @ self.w + self.b)

    def of_ids(self, ids: np.ndarray) -> float:
        return self.logit(np.concatenate([self.responses(ids), np.zeros((1, sum(SIZES) * FILTERS), np.float32)]), np.arange(len(ids), dtype=np.int32))

    def probability(self, logit: float, lang: str) -> float:
        z = (logit - self.threshold.get(lang, self.common)) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _best_threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Middle of the gap at which the two classes' error rates add up to the least (the widest such gap); of the only class's far side if there is one. A logit counts ``n`` times."""
    if not len(z):
        return 0.0
    if y.all() or not y.any():
        return float(z.min() - 1) if y.all() else float(z.max() + 1)
    order = np.argsort(z)
    z, y = z[order], y[order]
    n = np.ones(len(z), np.int64) if n is None else n[order]
    bad, good = np.cumsum(n * y), np.cumsum(n * (1 - y))
    miss = np.concatenate([[0], bad]) / bad[-1] + (good[-1] - np.concatenate([[0], good])) / good[-1]
    ends = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(ends)
    best = np.flatnonzero((gap > 0) & (miss <= miss[gap > 0].min() + 1e-12))
    k = best[gap[best].argmax()]
    return float((ends[k] + ends[k + 1]) / 2)


def train_rows(ids: list[np.ndarray], y: np.ndarray, held: np.ndarray, langs: list[str], epochs: int = 8, rate: float = 0.05, keep: float = KEEP, seed: int = 9) -> ToxicityModel:
    model, rng = ToxicityModel(seed), np.random.default_rng(seed)
    train = np.flatnonzero(~held)
    if len(train) and 0 < y[train].sum() < len(train):
        weigh = {1: len(train) / (2 * y[train].sum()), 0: len(train) / (2 * (1 - y[train]).sum())}
        for k in range(epochs):
            for i in rng.permutation(train):
                words = ids[i][rng.random(len(ids[i])) < keep] if len(ids[i]) > 3 else ids[i]
                if len(words):
                    model.step(words, int(y[i]), rate * (1 - k / epochs), weigh[int(y[i])])
    check = np.flatnonzero(held) if held.any() and 0 < y[held].sum() < held.sum() else train
    z = np.array([model.of_ids(ids[i]) for i in check])
    calibrate(model, z, y[check], np.array([langs[i] for i in check]), np.ones(len(check), np.int64))
    return model


def calibrate(model: ToxicityModel, z: np.ndarray, y: np.ndarray, tag: np.ndarray, n: np.ndarray) -> None:
    """Sets the thresholds and the scale of ``model`` from logits ``z`` that count ``n`` times, their labels and languages."""
    model.threshold, model.common, model.scale = {}, _best_threshold(z, y, n), 1.0
    if len(z):
        mean = np.average(z, weights=n)
        model.scale = float(max(np.sqrt(np.average((z - mean) ** 2, weights=n)) / 2, 1e-3))
    for lang in sorted(set(tag)):
        of = tag == lang
        m = min((n * y)[of].sum(), (n * (1 - y))[of].sum())
        model.threshold[lang] = float((m * _best_threshold(z[of], y[of], n[of]) + SHRINK * model.common) / (m + SHRINK))


class Scorer:
    """A model with the responses of the words that a task has met."""

    def __init__(self, model: ToxicityModel):
        self.model, self.words, self.letters = model, Words(), language.Letters()
        self.known, self.begun, self.table = 0, 0, np.zeros((MEMO, sum(SIZES) * FILTERS), np.float32)

    def read(self, text: str | None) -> tuple[float, int]:
        """Logit of a text and the index of its language."""
        words = self.words.of(text)
        n = len(self.words)
        if self.begun != self.words.begun:
            self.known, self.begun = 0, self.words.begun
        if n + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(n + 1 - len(self.table), len(self.table)), self.table.shape[1]), np.float32)])
        if n > self.known:
            self.table[self.known : n] = self.model.responses(self.words.parts[self.known : n])
            self.known = n
        self.table[-1] = 0
        i, _ = self.model.languages.scores(text, self.letters)
        return self.model.logit(self.table, words), i

    def score(self, text: str | None) -> float:
        z, i = self.read(text)
        return self.model.probability(z, self.model.languages.langs[i] if i >= 0 else language.UNKNOWN)


def _ids(docs: DataFrame, lang: language.LanguageModel) -> pa.Table:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, letters = Words(), language.Letters()
        for b in batches:
            found, tags = [], []
            for t in b.column(0).to_pylist():
                at = words.of(t)
                found.append(words.parts[at].ravel())
                i, _ = lang.scores(t, letters)
                tags.append(lang.langs[i] if i >= 0 else language.UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(tags, pa.string()), pa.array(found, pa.list_(pa.int32()))], names=["y", "key", "lang", "ids"])

    return docs.mapInArrow(run, "y int, key long, lang string, ids array<int>").toArrow()


def _go_on(rows: DataFrame, model: ToxicityModel, chunks: int, weigh: dict[int, float], rate: float, number: int) -> None:
    """One reading of ``rows(doc_id, key, y, text)``: each chunk of documents goes on from ``model`` by itself; a parameter then moves by the mean of the chunks that moved it.

    Chunks are dealt by the hash of the id and read in hash order, of rows of one id only the first; a task holds one Arrow batch and one model.
    """
    hashed = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(chunks)).alias("chunk"), "key", "doc_id", F.xxhash64("text").alias("h"), "y", "text")
    dealt = hashed.repartition("chunk").sortWithinPartitions("chunk", "key", "doc_id", "h")
    names = [f"d{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, own, now, last, rng = Words(), model.flat(), ToxicityModel(), None, None, None

        def moved() -> pa.RecordBatch:
            d = np.rint((own.flat() - start).astype(np.float64) * UNIT).astype(np.int64)
            hit = np.flatnonzero(d.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *[pa.array(np.ascontiguousarray(d[hit, i])) for i in range(WIDTH)]], names=["row", *names])

        for b in batches:
            for chunk, _, doc, _, y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield moved()
                    own.load(start)
                    now, rng = chunk, np.random.default_rng([number, chunk])
                if (chunk, doc) == last:
                    continue
                last, at = (chunk, doc), words.of(text)
                at = at[rng.random(len(at)) < KEEP] if len(at) > 3 else at
                if len(at):
                    own.step(words.parts[at], y, rate, weigh[y])
        if now is not None:
            yield moved()

    found = dealt.mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in names))
    found = materialize(found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]), "toxicity-moves").toArrow()  # a row for each bucket at most
    flat, row, n = model.flat(), found["row"].to_numpy(), found["n"].to_numpy()
    flat[row] += (np.stack([found[c].to_numpy() for c in names], axis=1) / n[:, None] / UNIT).astype(np.float32)
    model.load(flat)


def _calibration(rows: DataFrame, model: ToxicityModel) -> pa.Table:
    """``(y, lang, z, n)``: how often ``rows(doc_id, y, text)`` have a logit, in steps; of rows of one id the first by the hash of its text counts."""
    lang = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.read(t) for t in b.column(3).to_pylist()]
            z = np.rint(np.clip([z for z, _ in found], -FAR, FAR) * STEPS).astype(np.int64)
            tags = pa.array([lang.langs[i] if i >= 0 else language.UNKNOWN for _, i in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z), tags], names=["doc_id", "y", "h", "z", "lang"])

    src = rows.select("doc_id", "y", F.xxhash64("text").alias("h"), "text")
    read = src.mapInArrow(run, T.StructType([*src.schema.fields[:3], T.StructField("z", T.LongType()), T.StructField("lang", T.StringType())]))
    each = read.groupBy("doc_id", "y").agg(F.min(F.struct("h", "z", "lang")).alias("one"))
    return materialize(each.groupBy("y", F.col("one.lang").alias("lang"), F.col("one.z").alias("z")).agg(F.count(F.lit(1)).alias("n")), "toxicity-logits").toArrow()


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> ToxicityModel:
    """Model from all of ``labels(doc_id, toxic)`` of rows where ``learnable`` (on doc_id) holds.

    It starts with the first ``sample`` documents of each class in hash order. If there are more, ``ROUNDS`` readings of all of them
    follow, and thresholds come from all of the fifth that training leaves out (from the others, if that fifth lacks a class).
    """
    known = labels.where(learnable & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("key", F.xxhash64("doc_id", F.lit(23))), "toxicity-labels")
    chosen = common.first_of_each(known.drop("key"), "y", sample, 23)
    lang = language.train(docs.select("doc_id", "text", "lang"), learnable, language.SAMPLE)
    rows = _ids(common.one_row_each(docs.join(chosen, "doc_id"), ["doc_id", "y"]).select(F.coalesce("text", F.lit("")).alias("text"), "y", "key"), lang)
    key, y, ids = rows["key"].to_numpy(), rows["y"].to_numpy(), common.list_views(rows["ids"])
    order = np.lexsort((y, key))  # the same whatever task came first
    tags = rows["lang"].to_pylist()
    model = train_rows([ids[i].reshape(-1, len(PARTS)) for i in order], y[order].astype(np.int64), key[order] % 5 == 0, [tags[i] for i in order])
    model.languages = lang
    held = F.pmod("key", F.lit(5)) == 0
    count = {(r.y, r.held): r["count"] for r in known.groupBy("y", held.alias("held")).count().collect()}
    if sum(count.values()) <= len(y):
        return model
    texts = docs.where(learnable).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    everything = materialize(texts.join(known.hint("merge"), "doc_id"), "toxicity-texts")  # labels grow with the texts: the same plan at any size
    own = {k: count.get((k, False), 0) for k in (0, 1)}
    if min(own.values()):
        weigh = {k: sum(own.values()) / (2 * n) for k, n in own.items()}
        for k in range(ROUNDS):
            _go_on(everything.where(~held), model, -(-sum(own.values()) // CHUNK), weigh, RATE * (1 - k / ROUNDS), k)
    both = count.get((0, True)) and count.get((1, True))
    seen = _calibration(everything.where(held if both else ~held), model)
    calibrate(model, seen["z"].to_numpy() / STEPS, seen["y"].to_numpy().astype(np.int64), np.array(seen["lang"].to_pylist(), dtype=object), seen["n"].to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (its columns but text) plus ``score`` and ``predicted`` (1 from 0.5 on).

    A NULL text scores as an empty one: the network's answer to no words. Whole texts are read. Repeated rows get equal results;
    an empty table gives an empty result; columns named like a new one are replaced; without labels of both classes nothing is toxic.
    """
    made = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    rest = [c for c in docs.columns if c != "text" and c.lower() not in made]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text"))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, t) for n, t in made.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            s = np.array(found, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return src.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, labels learned from the folds other than 0."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = common.fold(F.col("doc_id"), 5)
    model = train(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"), part != 0)
    return score(docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text"), model)
