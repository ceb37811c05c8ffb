from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from gapweave.llm import pieces, secret_scan
from gapweave.plans.storage import materialize

SF = "/root/testdata/sf0.001"


def first_of_each_group(texts, words=5, similar=0.8):
    """Smallest ids of the components of texts that share ``similar`` of their word shingles, by every pair with a shingle in common."""
    held, label = defaultdict(list), {i: i for i in texts}
    sets = {}
    for i, text in texts.items():
        parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        sets[i] = {tuple(parts[k : k + words]) for k in range(max(len(parts) - words + 1, 1))} if parts else set()
        for s in sets[i] or {()}:
            held[s].append(i)
    pairs = {p for ids in held.values() for p in combinations(sorted(ids), 2)}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in sorted(pairs):
        if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            label[high] = low
    return {root(i) for i in texts}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        seen[name] = docs
        assert name == "sentencepiece" or docs.columns == columns
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in seen["quality"].collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(label[i] == 1 for i in good if i in label) > 0.95 * sum(q == 1 for q in label.values())
    assert {r.doc_id for r in seen["simhash"].collect()} == first_of_each_group({i: start[i].text for i in good})
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert all(t == start[i].text or "[SECRET]" in t for i, t in clean.items())
    assert secret_scan.scan(seen["secrets"]).where("exists(spans, s -> s.kind <> 'assign')").count() == 0
    mixed = [r.doc_id for r in seen["mix"].collect()]
    assert set(mixed) <= set(clean) and max(map(mixed.count, mixed)) <= 3
    coder = pieces.PieceCoder(pieces.default_model())
    rows = seen["sentencepiece"].collect()
    assert len(rows) == len(mixed) and all(r.ids == coder.lib.encode(clean[r.doc_id], add_eos=True) for r in rows)


def test_stages_take_odd_rows(rows, spark):
    docs = rows.drop("size")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.where("false"), SF).collect()
