from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from gapweave.llm import overlap, simhash


def slow_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


@pytest.fixture(scope="module")
def planted():
    """Originals of several lengths, each with copies in which a few words are exchanged: similarities from 0.5 to 1."""
    rng = np.random.default_rng(3)
    words = ["w" + str(k) for k in range(5000)]
    texts = []
    for n in (1, 4, 6, 30, 60, 120, 200, 300, 500, 800):
        for _ in range(3):
            base = rng.choice(words, n).tolist()
            texts.append(" ".join(base))
            for share in (0.002, 0.01, 0.015, 0.02, 0.03, 0.06):
                texts.append(" ".join(w if rng.random() > share else str(rng.choice(words)) for w in base))
    return texts


def test_stage_keeps_one_of_every_component_at_0_8(spark, planted):
    sets = [slow_set(t) for t in planted]
    label = list(range(len(planted)))
    for a, b in combinations(range(len(planted)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_stage_follows_fingerprints_and_overlaps(spark):
    """Of a chain of three, the first two have one SimHash fingerprint but few common sets of words, the others overlap but differ in fingerprints."""
    rng = np.random.default_rng(4)
    tail = lambda n: " ".join("w" + str(k) for k in rng.integers(0, 10**6, n))
    first, end = "a b c " * 300 + tail(20), tail(60)
    texts = [first, "a b c " * 300 + end, "a b c " + end, tail(40)]
    fp = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts]
    sets = [slow_set(t) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= 3 < (fp[1] ^ fp[2]).bit_count()
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1]) and len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2])
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 3]
    assert sorted(r.doc_id for r in overlap.one_of_each(docs).collect()) == [0, 1, 3]


def test_pairs_at_the_level():
    sets = [np.arange(10), np.arange(8), np.arange(7), np.arange(20, 29), np.zeros(0, np.int64)]
    i = np.arange(5)
    a, b = overlap.similar_pairs([s.astype(np.int64) for s in sets], i, i)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y} == {(0, 1), (1, 2)}


@pytest.mark.parametrize("chunk", [3, 512])
def test_tiles_span_a_large_group(spark, chunk):
    sets = [(k, 0, 40, [*range(100), 1000 + k]) for k in range(39)] + [(39, 0, 40, list(range(50)))]
    found = overlap.links(spark.createDataFrame(sets, "item long, loose long, n long, set array<long>"), chunk).collect()
    label = list(range(40))
    for r in found:
        lo, hi = sorted((label[r.u], label[r.v]))
        label = [lo if x == hi else x for x in label]
    assert label == [0] * 39 + [39]


def test_odd_rows(rows):
    kept = overlap.one_of_each(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7]
    assert overlap.one_of_each(rows.where("false")).count() == 0
