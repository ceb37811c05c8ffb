"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is normalised as the library does it for these models (white space marks, one mark in front), and cut
in front of every run of marks: no piece of a merge vocabulary holds a mark after another character, so no
merge crosses such a cut and each unit can be encoded alone. A unit's symbols are merged through an agenda of
adjacent pairs ordered by score, leftmost first among equals. Short units of equal length share a matrix of
pair scores, and each round merges the best pair of every row; long units have a heap each, where pairs whose
symbols have changed since are skipped when they surface. Every unit that an Arrow batch sees for the first time is also encoded
by the sentencepiece library; if the two ever disagreed, the library's ids would stand.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gapweave.llm import common

MARK = "▁"
#: Units are remembered up to this length and number per task; longer or later ones are encoded anew.
MEMO_CHARS, MEMO_UNITS = 48, 400_000
#: Units up to this many characters are merged in matrices.
MATRIX_CHARS = 24


def merge_by_score(unit: str, scores: dict[str, float]) -> list[str]:
    """Pieces of one unit: repeatedly merge the adjacent pair whose union scores highest."""
    sym: list[str | None] = list(unit)
    n = len(sym)
    if n == 1:
        return [unit]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := unit[i : i + 2]) in scores]
    heapq.heapify(agenda)
    while agenda:
        _, a, b, piece = heapq.heappop(agenda)
        if sym[a] is None or sym[b] is None or after[a] != b or len(sym[a]) + len(sym[b]) != len(piece):
            continue
        sym[a], sym[b] = piece, None
        c = after[a] = after[b]
        if c >= 0:
            before[c] = a
            if (p := piece + sym[c]) in scores:
                heapq.heappush(agenda, (-scores[p], a, c, p))
        if (c := before[a]) >= 0 and (p := sym[c] + piece) in scores:
            heapq.heappush(agenda, (-scores[p], c, a, p))
    return [s for s in sym if s is not None]


class PieceCoder:
    """Encoder and decoder over the vocabulary of one model file (bytes), built once per task."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.byte_ids = {int(lib.id_to_piece(i)[3:-1], 16): i for i in ids if lib.is_byte(i)}
        self.text = {i: lib.id_to_piece(i).replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark after another character: units cannot be cut at marks")
        self.names = [str(i) for i in ids]
        self.bytes_of = [self.text.get(i, b"") for i in ids]
        self._pair_table(len(self.names))
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memo: dict[str, list[int]] = {}
        self.disagreed = 0

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in merge_by_score(unit, self.scores):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _pair_table(self, n: int) -> None:
        """Sorted (left id, right id) keys of all pairs whose union is a piece, with its id and score."""
        chars = {c for p in self.ids for c in p} - set(self.ids)
        symbol = self.ids | {c: n + k for k, c in enumerate(sorted(chars))}
        self.width, self.loose, rows = n + len(chars), sorted(chars), []
        for p, i in self.ids.items():
            rows += [(symbol[p[:k]] * self.width + symbol[p[k:]], i) for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        key, piece = np.array(sorted(rows), dtype=np.int64).reshape(-1, 2).T
        self.pair_key, self.pair_id = np.append(key, np.iinfo(np.int64).max), np.append(piece, -1).astype(np.int32)
        self.pair_cost = np.array([-self.lib.get_score(int(i)) for i in piece] + [np.inf])
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (infinite: no piece) and union of symbol pairs; negative symbols are characters outside the vocabulary."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.searchsorted(self.pair_key, key)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_cost[at], np.inf), self.pair_id[at]

    def _merge_rows(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row (units of one length) to the end; symbols and how many are left in each row."""
        n, size = sym.shape
        left = np.full(n, size)
        if size < 2:
            return sym, left
        cost, union = self._pairs(sym[:, :-1], sym[:, 1:])
        live, done = np.arange(n), sym.copy()
        while len(live):
            j = cost.argmin(axis=1)
            row = np.arange(len(live))
            on = np.isfinite(cost[row, j])
            if not on.all():
                done[live[~on]] = sym[~on]
                live, sym, cost, union, j = live[on], sym[on], cost[on], union[on], j[on]
                row = np.arange(len(live))
                if not len(live):
                    break
            sym[row, j] = union[row, j]
            shift = np.arange(size - 1)[None, :] > j[:, None]
            tail = np.concatenate([sym[:, 2:], np.full((len(live), 1), -1, sym.dtype)], axis=1)
            sym[:, 1:] = np.where(shift | (np.arange(size - 1)[None, :] == j[:, None]), tail, sym[:, 1:])
            moved = np.concatenate([cost[:, 1:], np.full((len(live), 1), np.inf)], axis=1)
            cost = np.where(shift[:, : cost.shape[1]], moved, cost)
            union = np.where(shift[:, : union.shape[1]], np.concatenate([union[:, 1:], union[:, -1:]], axis=1), union)
            left[live] -= 1
            for k, ok in ((j - 1, j > 0), (j, j < left[live] - 1)):
                k = np.clip(k, 0, size - 2)
                c, u = self._pairs(sym[row, k], sym[row, k + 1])
                cost[row, k] = np.where(ok, c, np.where(k == j, np.inf, cost[row, k]))
                union[row, k] = np.where(ok, u, union[row, k])
        return done, left

    def _char_ids(self, code: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(code).encode()] if self.byte_ids else [self.unknown]

    def by_agenda(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in units]
        by_size: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if len(u) <= MATRIX_CHARS and self.byte_ids:
                by_size.setdefault(len(u), []).append(k)
            else:
                out[k] = self.unit_ids(u)
        for size, rows in by_size.items():
            code = np.frombuffer("".join(units[k] for k in rows).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
            sym, left = self._merge_rows(np.where((found := self.char_id[code]) >= 0, found, -2 - code.astype(np.int32)))
            plain = ((sym < len(self.names)) & (sym >= 0)) | (np.arange(size)[None, :] >= left[:, None])
            for k, s, m, ok in zip(rows, sym.tolist(), left.tolist(), plain.all(axis=1).tolist(), strict=True):
                out[k] = s[:m] if ok else [i for x in s[:m] for i in ([x] if 0 <= x < len(self.names) else self._char_ids(-2 - x if x < 0 else ord(self.loose[x - len(self.names)])))]
        return out

    def learn(self, fresh: list[str]) -> dict[str, list[int]]:
        """Ids of units by the agenda; a unit for which the library has others is an error."""
        mine = self.by_agenda(fresh)
        theirs = self.lib.encode([u[1:].replace(MARK, " ") for u in fresh], num_threads=1)
        theirs = [a if u == MARK else b for u, a, b in zip(fresh, mine, theirs, strict=True)]  # the library adds no mark to an empty text
        if mine != theirs:
            wrong = [(u, a, b) for u, a, b in zip(fresh, mine, theirs, strict=True) if a != b]
            self.disagreed += len(wrong)
            u, a, b = wrong[0]
            raise ValueError(f"agenda and library disagree on {len(wrong)} units, first {u[:80]!r}: {a[:20]} and {b[:20]}")
        return dict(zip(fresh, mine, strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, the end id last."""
        cut = [self.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = set(chain.from_iterable(cut))
        fresh = list(seen.difference(self.memo))
        if len(self.memo) + len(fresh) > MEMO_UNITS:
            self.memo.clear()
            fresh = list(seen)
        now = self.learn(fresh)
        known = self.memo
        known.update(now)
        for units in cut:
            ids = list(chain.from_iterable(map(known.__getitem__, units)))
            ids.append(self.end)
            yield ids
        for u in now:
            if len(u) > MEMO_CHARS:
                del known[u]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks to spaces, bytes joined, controls silent, the first mark dropped."""
        of = self.bytes_of
        out = b"".join([of[i] for i in ids])
        return out.decode("utf-8", "replace").removeprefix(" ")


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_tokens``, ``ids`` (array, end id last), and digests of ids and decoded text.

    NULL is encoded as the empty text (only the end id). Repeated rows give repeated rows; an empty table gives
    an empty result. Columns of ``docs`` named like a new one are replaced. ``keep_text`` returns the decoded text too.
    """
    made = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    made += [("decoded", T.StringType())] * keep_text
    rest = [c for c in docs.columns if c != text and c.lower() not in {m for m, _ in made}]
    src = docs.select(*[docs[f"`{c}`"] for c in rest], docs[f"`{text}`"].alias(common.unique_name(docs.select(*[f"`{c}`" for c in rest]), "_text")))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, t) for n, t in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                n, ids, shas, dec_shas, dec = [], [], [], [], []
                for x in coder.encode_batch([t or "" for t in b.column(b.num_columns - 1).to_pylist()]):
                    n.append(len(x))
                    ids.append(pa.array(x, pa.int32()))
                    shas.append(hashlib.sha256(" ".join([coder.names[i] for i in x]).encode()).hexdigest())
                    dec.append(coder.decode(x))
                    dec_shas.append(hashlib.sha256(dec[-1].encode()).hexdigest())
                offsets = pa.array([0, *accumulate(n)], pa.int32())
                cols = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)), pa.array(shas), pa.array(dec_shas)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols, *([pa.array(dec)] if keep_text else [])], names=schema.names)

    return src.mapInArrow(run, schema)


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> bytes:
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents encoded with an end id and decoded again; digests of both."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, default_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
