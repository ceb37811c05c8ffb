import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gapweave.llm import line_filter as lf

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def slow(texts, min_docs, counted=None):
    n = Counter(k for t in (texts if counted is None else counted) for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if n[key(x)] < min_docs or not key(x)]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def texts(seed, n):
    rng = np.random.default_rng(seed)
    pool = ["Share this page", "  SHARE this PAGE\t", "", " ", "é È", "É è", "all rights reserved\r", "\x0bx\x0c", "\xa0nbsp"] + [f"line {i}" for i in range(60)]
    made = ["\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 9))) for _ in range(n)]
    return [None, "", "\n", *made, made[0], made[0]]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(data)], "doc_id long, text string, _h1 string, kept string")


def shown(df):
    return sorted((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in df.collect())


def test_filter_holds_adds_and_removes():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 60_000)
    slots = np.zeros((lf.BUCKETS, lf.SLOTS), dtype=np.uint32)
    assert lf.add_keys(slots, h[:50_000])
    assert lf.has_keys(slots[None], np.zeros(50_000, dtype=int), h[:50_000]).all()
    before = np.sort(slots, axis=1)
    assert lf.add_keys(slots, np.repeat(h[50_000:50_010], 3))  # equal fingerprints are held as often as they are added
    lf.remove_keys(slots, np.repeat(h[50_000:50_010], 3))
    lf.remove_keys(slots, h[:20_000])
    assert lf.has_keys(slots[None], np.zeros(30_000, dtype=int), h[20_000:50_000]).all()
    assert not lf.has_keys(slots[None], np.zeros(10_000, dtype=int), h[50_000:]).any()
    assert (before != 0).sum() - (slots != 0).sum() == 20_000
    with pytest.raises(ValueError):
        lf.remove_keys(slots, h[:1])
    assert not lf.add_keys(np.zeros((lf.BUCKETS, lf.SLOTS), dtype=np.uint32), rng.integers(-(2**63), 2**63 - 1, 66_000))


@pytest.mark.parametrize("most,indexed", [(lf.MOST_BYTES, True), (0, True), (lf.MOST_BYTES, False)])
def test_against_brute_force(spark, most, indexed):
    data = texts(1, 150)
    docs = frame(spark, data)
    index = lf.insert(lf.empty(spark, min_docs=10), docs)
    got = lf.drop_lines(index, docs, indexed, most)
    assert got.columns == ["doc_id", "text", "_h1", "kept", "n_lines", "n_dropped"]
    assert shown(got) == sorted((i, *x) for i, x in enumerate(slow(data, 10)))


def test_false_alarms_are_named(spark, monkeypatch):
    """With fingerprints cut to 3 bits nearly every key is a false alarm; the result stays exact."""
    data = texts(2, 120)
    docs = frame(spark, data)
    plain = lf._places
    monkeypatch.setattr(lf, "_places", lambda h: plain((h.view(np.uint64) & np.uint64(0x0000000700000007)).view(np.int64)))
    index = lf.insert(lf.empty(spark, min_docs=12), docs)
    assert shown(lf.drop_lines(index, docs)) == sorted((i, *x) for i, x in enumerate(slow(data, 12)))


def test_insert_then_delete_is_as_before(spark):
    old, new = texts(3, 120), texts(4, 90)
    a, b = frame(spark, old), frame(spark, new)
    one = lf.insert(lf.empty(spark), a)
    two = lf.insert(one, b)
    assert shown(lf.drop_lines(two, a)) == sorted((i, *x) for i, x in enumerate(slow(old, 10, old + new)))
    back = lf.delete(two, b)
    assert sorted(back.refs.collect()) == sorted(one.refs.collect())
    held = lambda ix: {int(x) for r in ix.filters.collect() for x in np.frombuffer(r.slots, dtype=np.uint32) if x}
    assert held(back) == held(one) and held(two) - held(one)
    assert shown(lf.drop_lines(back, a)) == shown(lf.drop_lines(one, a))
    gone = lf.delete(back, a)
    assert gone.refs.count() == 0 and not held(gone)
    with pytest.raises(ValueError):
        lf.delete(one, b)


def test_more_shards_when_filters_fill(spark, monkeypatch):
    data = texts(5, 150)
    docs = frame(spark, data)
    monkeypatch.setattr(lf, "SHARD_KEYS", 7)
    index = lf.insert(lf.insert(lf.empty(spark, min_docs=5), docs.where("doc_id < 60")), docs.where("doc_id >= 60"))
    assert index.shards > 5
    assert shown(lf.drop_lines(index, docs)) == sorted((i, *x) for i, x in enumerate(slow(data, 5)))


def test_odd_rows_and_empty_table(spark, rows):
    index = lf.insert(lf.empty(spark, min_docs=2), rows)
    got = {(r.doc_id, r.text): r for r in lf.drop_lines(index, rows).collect()}
    assert got[3, None].kept == "" and got[3, None].n_lines == 1 and got[3, None].n_dropped == 0
    assert got[1, "the quick brown fox jumps over the lazy dog and runs away"].kept == ""
    assert got[5, " \t\n"].kept == " \t\n" and got[5, " \t\n"].n_lines == 2
    none = rows.where("false")
    assert lf.drop_lines(lf.insert(lf.empty(spark), none), none).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in lf.op11_line_dedup(spark, sf).collect())
    assert got == sorted(con.execute(lf.OP11_SQL).fetchall())
    assert all(len(r[3]) == len(hashlib.sha256().hexdigest()) for r in got)
