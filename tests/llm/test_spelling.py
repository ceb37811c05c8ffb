import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gapweave.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """One insertion, deletion or replacement by edit distance."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def slow(words, ratio):
    form, out = {}, []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out.append((w, n, len(close)))
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, n, k, form[w], words.get(form[w]), root(w)) for w, n, k in out)


def made(seed, letters="abé", n=160, sizes=(1, 9)):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))) for _ in range(n)}
    return {w: 10 ** rnd.randint(0, 4) + rnd.randint(0, 1) for w in sorted(words)}


@pytest.mark.parametrize("words", [made(1), made(2, "ab", 200, (3, 8)), made(3, "abcdefgh", 200, (1, 3)), {"": 3, "a": 40, "b": 4, "ab": 9, "ba": 500}, {"x" * 300: 5, "x" * 299: 60, "x" * 150 + "y" + "x" * 149: 700, "y" + "x" * 299: 1}])
@pytest.mark.parametrize("cells", [spelling.BUCKET_CELLS, 40])
def test_against_edit_distance(spark, words, cells):
    df = spark.createDataFrame([(w, n, 7) for w, n in words.items()], "word string, n long, form int").repartition(3)
    got = spelling.variants(df.select("word", "n"), 10, cells)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()) == slow(words, 10)


def test_chains_of_forms(spark):
    words = {"aaaaaaa"[:k] + "b" * (7 - k): 10 ** (k + 1) for k in range(8)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), 10).collect()}
    assert set(got.values()) == {"a" * 7}


def test_a_hot_bucket_is_cut(spark):
    """A third of all words share half of their letters: windows are cut until tiles are small, and no pair is lost."""
    rnd = random.Random(5)
    words = sorted({"commonhalf" + "".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(1500)} | {"".join(rnd.choice("ghijkl") for _ in range(12)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 1 + i % 5) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(df, 1 << 14).collect()}
    letters, known = "abcdefghijklmno", set(words)
    for w in rnd.sample(words, 300):
        edits = {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert got[w] == len((edits & known) - {w})


def test_tiles_of_more_than_one_block():
    rnd = random.Random(7)
    words = sorted({"pre" + "".join(rnd.choice("abc") for _ in range(5)) for _ in range(400)} | {"pre" + "".join(rnd.choice("abc") for _ in range(4)) for _ in range(60)})
    rnd.shuffle(words)
    ones = np.ones(len(words), dtype=np.int64)
    i, j = spelling.near_rows(words, 8 * ones, 3 * ones, 0 * ones, ones)
    got = Counter(tuple(sorted((words[x], words[y]))) for x, y in zip(i, j))
    assert set(got.values()) == {1}
    # words of length 7 among themselves belong to the windows of m = 7
    assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b) and max(len(a), len(b)) == 8}


def slow_query(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def test_words_of_the_query(spark, tmp_path):
    rnd = random.Random(3)
    base = ["ÀÉîôûÿ×÷word", "Example", "EXAMPLES", "exampel", "tuning", "abcdefg"]
    rows = [(i % 50, " ".join(rnd.choice(base) + rnd.choice(["", ".", "1", "ß"]) for _ in range(40))) for i in range(120)] + [(None, "Example, example"), (5, None), (6, "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op13_spelling(spark, str(tmp_path)).collect())
    assert got == slow(slow_query(rows), 10) and any(r[3] for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op13_spelling(spark, str(tmp_path)).collect() == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    key = lambda r: (r[0], r[1] or "")
    got = sorted((tuple(r) for r in spelling.op13_spelling(spark, SF).collect()), key=key)
    assert got == sorted(con.execute(spelling.OP13_SQL).fetchall(), key=key)
