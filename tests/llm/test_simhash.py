import re

import numpy as np
import pytest
import xxhash

from gapweave.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b c", "A b c d\x0be f É é" * 9, "x y z " * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def components(fps, bits=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_span_all_near_pairs(spark, chunk):
    rng = np.random.default_rng(1)
    fps = set()
    for centre in rng.integers(0, 2**63, 12).tolist():  # balls and chains around a few centres
        at = centre
        for _ in range(25):
            fps.add(at)
            at ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False))
            at = at if rng.random() < 0.6 else centre
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), chunk=chunk).collect()
    where = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for r in found:
        a, b = sorted((label[where[r.u]], label[where[r.v]]))
        label = [a if x == b else x for x in label]
    assert label == components(fps)


def test_odd_rows(rows, spark):
    got = {(r.doc_id, r.source): r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got[1, "a"] == 1 and got[2, None] == 1 and got[6, "c"] == 6
    assert got[3, None] == got[4, "b"] == got[5, "b"] == 3  # no words: fingerprint zero, linked like any other
    assert got[None, "c"] is None
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7]
    assert simhash.near_duplicates(rows.where("false")).count() == 0 and simhash.one_of_each(rows.where("false")).count() == 0
