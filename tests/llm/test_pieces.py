import hashlib

import pytest

from gapweave.llm import pieces

ODD = [None, "", " ", "a", " a", "  a  b ", "a\nb\t c", "ﬁ Ａ é", "x▁y", "\0z", "<s> </s> hi", "😀   😀", "▁", "a" * 3000, "ab " * 3000, "﻿x�", "ééé" * 40, "token, token; tokens."]


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.default_model())


def test_agenda_equals_library(coder):
    texts = [t or "" for t in ODD]
    assert list(coder.encode_batch(texts)) == coder.lib.encode(texts, add_eos=True)
    assert coder.disagreed == 0


def test_an_error_of_the_agenda_is_not_hidden(monkeypatch):
    own = pieces.PieceCoder(pieces.default_model())
    right = own.by_agenda
    monkeypatch.setattr(own, "by_agenda", lambda units: [x[::-1] for x in right(units)])
    with pytest.raises(ValueError, match="disagree"):
        list(own.encode_batch(["internationalisation of it"]))


def test_heap_and_matrix_agree(coder):
    units = ["▁" + u for u in ("internationalisation", "übergänge", "x", "aaaaaaaaaaaaaaa", "żółć", "")]
    assert coder.by_agenda(units) == [coder.unit_ids(u) for u in units]


def test_decode_equals_library(coder):
    for ids in coder.lib.encode([t or "" for t in ODD], add_eos=True):
        assert coder.decode(ids) == coder.lib.decode(ids)


def test_rows(rows, coder):
    df = rows.withColumnRenamed("size", "ids")
    got = pieces.encode_decode(df, pieces.default_model(), keep_text=True).collect()
    assert len(got) == rows.count() and pieces.encode_decode(rows.where("false"), pieces.default_model()).count() == 0
    for r in got:
        want = coder.lib.encode(r.decoded, add_eos=True)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
