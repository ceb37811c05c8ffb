"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters (lower case, anything else a boundary) give character n-grams, each hashed to a bucket with a learned
vector; the text is the average of its vectors and a linear softmax reads the language off it. Vectors and softmax are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled documents and short spans of them. A
temperature and a rejection level are fitted on documents of the sample that training did not see. For
scoring, vectors and softmax fold into one table of logits per bucket, and every n-gram of the whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common

#: Labelled documents of a language that training reads at most, spans cut from each, buckets, n-gram lengths, vector size.
SAMPLE, SPANS, BITS, GRAMS, WIDTH = 500, 3, 15, (2, 3, 4), 16
#: Letters read at a time, and accuracy that accepted texts shall reach.
PIECE, ACCURACY = 1 << 18, 0.99
UNKNOWN = "und"


class Letters:
    """Lower-cased letters of a text as numbers, 0 for anything else."""

    def __init__(self):
        lower = [c.lower() if (c := chr(i)).isalpha() else "" for i in range(0x10000)]
        self.table = np.array([ord(c[0]) if c else 0 for c in lower], dtype=np.uint32)

    def of(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        if len(code) and code.max() < 0x10000:
            return self.table[code]
        out = self.table[np.minimum(code, 0xFFFF)]
        for c in np.unique(code[code > 0xFFFF]).tolist():
            out[code == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
        return out


def buckets(letters: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of a text between boundaries; n-grams that span a boundary inside are left out."""
    a = np.concatenate([[0], letters, [0]]).astype(np.uint32)
    live = a > 0
    out, h, inner = [], np.full(len(a), 0x9E3779B1, dtype=np.uint32), np.ones(len(a), bool)
    for n in range(1, max(GRAMS) + 1):  # an n-gram's hash goes on from the one a letter shorter
        m = len(a) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ a[n - 1 :]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n >= 3:
            inner = inner[:m] & live[n - 2 : n - 2 + m]
        if n in GRAMS:
            keep = live[:m] & live[n - 1 :] if n == 2 else inner[:m]
            out.append(((h * np.uint32(2 * n + 0x27D4EB2F)) >> np.uint32(32 - BITS))[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pieces(text: str) -> Iterator[str]:
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE]


def _features(docs: DataFrame, spans: int) -> DataFrame:
    """``(lang, doc, bucket, count)``: bucket counts of each text and of some of its spans, as arrays no longer than the bucket table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            lang, doc, bucket, count = [], [], [], []
            for text, tag, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rng = np.random.default_rng(key & 0x7FFFFFFF)
                words = text.split()
                cuts = [" ".join(words[i : i + int(rng.integers(1, 13))]) for i in rng.integers(0, max(len(words), 1), spans)] if len(words) > 12 else []
                for t in [text, *cuts]:
                    total = sum(np.bincount(buckets(letters.of(p)), minlength=1 << BITS) for p in pieces(t)) if t else np.zeros(1, int)
                    if (hit := np.flatnonzero(total)).size:
                        lang.append(tag)
                        doc.append(key)
                        bucket.append(hit.astype(np.int32))
                        count.append(total[hit].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(doc, pa.int64()), pa.array(bucket, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.float32()))], names=["lang", "doc", "bucket", "count"])

    return docs.mapInArrow(run, "lang string, doc long, bucket array<int>, count array<float>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """Learned languages, logits per bucket, temperature and rejection level."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, level: float):
        self.langs, self.bias, self.temperature, self.level = langs, bias, temperature, level
        self.logits = [np.ascontiguousarray(logits[:, k]) for k in range(len(langs))]  # one array a language: sums run along memory

    def scores(self, text: str | None, letters: Letters) -> tuple[int, float]:
        """Index of the likeliest language and its probability; -1 for a text without letters."""
        if not self.langs:
            return -1, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for p in pieces(text or ""):
            b = buckets(letters.of(p))
            total += [x[b].sum(dtype=np.float64) for x in self.logits]
            n += len(b)
        if not n:
            any_letter = any((letters.of(p) > 0).any() for p in pieces(text or ""))
            if not any_letter:
                return -1, 0.0
        p = _softmax((total / max(n, 1) + self.bias) / self.temperature)
        return int(p.argmax()), float(p.max())


def train_rows(rows: pa.Table, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> LanguageModel:
    """Stochastic gradient descent over feature rows, one text at a time; a fifth of the documents calibrates."""
    tags, docs = np.array(rows["lang"].to_pylist(), dtype=object), rows["doc"].to_numpy()
    langs = sorted(set(tags))
    if len(langs) < 2:
        return LanguageModel(langs, np.zeros((1 << BITS, max(len(langs), 1)), np.float32), np.zeros(max(len(langs), 1)), 1.0, 0.0)
    bucket, weight = common.list_views(rows["bucket"]), common.list_views(rows["count"])
    order = sorted(range(len(docs)), key=lambda i: (docs[i], tags[i], len(bucket[i]), bucket[i].tobytes()))  # the same whatever task came first
    y = np.array([langs.index(t) for t in tags])
    rng = np.random.default_rng(seed)
    held = docs % 5 == 0
    if held.all() or not held.any():
        held = np.zeros(len(docs), bool)
    e = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    train = np.array([i for i in order if not held[i]])
    for k in range(epochs):
        lr = rate * (1 - k / epochs)
        for i in rng.permutation(train):
            b, c = bucket[i], weight[i] / weight[i].sum()
            x = c @ e[b]
            d = _softmax(x @ w + bias)
            d[y[i]] -= 1
            g = w @ d
            w -= lr * np.outer(x, d)
            bias -= 0.1 * lr * d
            e[b] -= (lr * min(len(b), 50)) * np.outer(c, g)
    logits = e @ w
    check = np.array([i for i in order if held[i]]) if held.any() else train
    z = np.array([weight[i] / weight[i].sum() @ logits[bucket[i]] + bias for i in check])
    own = y[check]
    grid = np.geomspace(0.1, 10, 41)
    temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean()))
    p = _softmax(z / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == own
    best = np.argsort(-top, kind="stable")
    good = np.cumsum(right[best]) / np.arange(1, len(best) + 1) >= ACCURACY
    level = float(top[best][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(langs, logits, bias, temperature, level)


def train(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> LanguageModel:
    """Model from the rows of ``docs(doc_id, text, lang)`` where ``learnable`` holds: the first ``sample`` of each language in hash order."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = common.first_of_each(known.select("doc_id", "lang").distinct(), "lang", sample, 17).select("doc_id", "lang", "key")
    rows = common.one_row_each(known.select("doc_id", "text", "lang").join(chosen, ["doc_id", "lang"]), ["doc_id", "lang"])
    return train_rows(_features(rows.select("text", "lang", "key"), SPANS).toArrow())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (its columns but text) plus ``lang_pred``, ``score`` and ``accepted``.

    ``lang_pred`` is the likeliest learned language, ``und`` with score 0 for a NULL text, one without letters, or a model without languages.
    ``accepted`` is false where the score is under the level at which accepted texts were right often enough on held-back
    documents. Whole texts count. Repeated rows get equal results; an empty table gives an empty result; columns named like a new one are replaced.
    """
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "accepted": T.BooleanType()}
    rest = [c for c in docs.columns if c != "text" and c.lower() not in made]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text"))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, t) for n, t in made.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            found = [model.scores(t.as_py(), letters) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([model.langs[i] if i >= 0 else UNKNOWN for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([i >= 0 and s >= model.level for i, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return src.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 1."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = common.fold(F.col("doc_id"), 3)
    model = train(docs, part != 1)
    found = identify(docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")
