"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags, each with the path of tags, classes and ids above it.
Every block has a tag-path vector (the sum of fixed random vectors of its path's tokens), a hashed-word vector and a few sizes;
a bidirectional LSTM in numpy reads the whole sequence and labels each block as main text or not. It is trained here on a
bounded sample of the pages and on re-arranged copies of them, in which the same texts are placed under other
layouts; the labels of both come from where a block was put (article, or a named part around it). Script, style and the like
never become blocks; text inside svg and math belongs to the block around it. Main blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common
from gapweave.plans.storage import materialize

#: Pages that training reads at most, blocks of a stretch (training reads a long page stretch by stretch, all of it), re-arranged copies of each, sizes of the vectors and of the hidden state.
SAMPLE, STRETCH, COPIES, PATH_DIM, WORD_DIM, HIDDEN = 100, 80, 8, 192, 16, 16
#: Cells (pages x blocks) that the network reads at a time.
CELLS = 65_536

# HTML element names.
RAW = "script|style|template|title|iframe|textarea"  # their content is not text of the page
FOREIGN = frozenset(("svg", "math"))
# Start tags that end svg and math, and elements that stand inside a paragraph.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
PHRASING = frozenset("noscript object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names of page parts that are not main text.
OTHER = frozenset(
    "nav menu menubar navbar navigation header masthead footer aside sidebar ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies "
    "consent notice alert popup modal dialog newsletter subscribe signup form button select search login comment comments reply replies respond disqus share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal".split()
)
# Beginnings of class names that say what a page has or lacks, not what an element is.
ABOUT_PAGE = ("has-", "no-", "with-", "without-", "is-", "hide-", "show-")

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>""", re.S | re.I)
EMPTY = re.compile(r"""<[a-z]+(?:[^>"']++|"[^"]*"|'[^']*')*+(?<=/)>""", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")


def _tokens(tag: str, attributes: str) -> str:
    """The element's name and the words of its class, id and role; those of the whole page and of what it has or lacks do not count."""
    if "=" not in attributes or tag in ("html", "body"):
        return tag
    names = [n for m in ATTRIBUTE.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().replace("_", "-").split() if not n.startswith(ABOUT_PAGE)]
    parts = [p for n in names for p in NAME_PART.findall(n)]
    return " ".join([tag, *("." + p for p in parts)])


def _path(stack: list[tuple[str, str, str]]) -> str:
    if not stack:
        return ""
    _, element, above = stack[-1]
    return above if above == element or above.endswith(">" + element) else above + ">" + element


def leaf_blocks(page: str) -> list[tuple[str, str, float]]:
    """(path, text, share of its characters inside links) of every non-blank leaf block; elements of the path are joined by ``>``.

    Of like elements inside each other the path names one, and the last element always; so it does not grow with the nesting of a page.
    """
    stack: list[tuple[str, str, str]] = []  # tag, element, elements above and here
    open_tags: Counter[str] = Counter()
    open_elements: Counter[str] = Counter()
    out: list[tuple[str, str, float]] = []
    text: list[str] = []
    linked = in_link = pos = foreign = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((_path(stack), words, min(1.0, linked / len(words))))
            text.clear()
            linked = 0

    def leave(k: int) -> None:
        for tag, element, _ in stack[k:]:
            open_tags[tag] -= 1
            open_elements[element] -= 1
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece)

    while m := TOKEN.search(page, pos):
        add(page[pos : m.start()])
        pos = m.end()
        if m[3] is None:
            if m[1] and foreign and (empty := EMPTY.match(page, m.start())):  # <title/> of an svg has no end tag
                pos = empty.end()
            continue
        tag, closing = m[3].lower(), m[2] == "/"
        if tag in FOREIGN:
            foreign = max(foreign - 1, 0) if closing else foreign + (not m[4].endswith("/"))
            continue
        if foreign and not (open_tags[tag] if closing else tag in BREAKOUT):
            continue
        foreign = 0
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in INLINE:
            continue
        elif closing:
            flush()
            in_link = 0
            if open_tags[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        else:
            flush()
            in_link = 0
            inside = tag in PHRASING or "-" in tag
            if stack and (stack[-1][0] == "p" and not inside or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                leave(len(stack) - 1)
            if tag not in VOID and not m[4].endswith("/"):
                element, above = _tokens(tag, m[4]), stack[-1][2] if stack else ""
                stack.append((tag, element, above if open_elements[element] else (above + ">" + element if above else element)))
                open_tags[tag] += 1
                open_elements[element] += 1
    add(page[pos:])
    flush()
    return out


def named_part(path: str) -> bool:
    """Label of a training block: True unless the path names a part that is not main text."""
    return not any(t.lstrip(".") in OTHER for t in path.replace(">", " ").split())


class Features:
    """Vectors of blocks, remembered by path."""

    def __init__(self):
        self.paths: dict[str, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: str) -> np.ndarray:
        if (v := self.paths.get(path)) is None:
            elements = path.split(">") if path else []
            tokens = {t for e in elements for t in e.split()} | {"last:" + t for t in (elements[-1].split() if elements else [])}
            v = np.zeros(PATH_DIM, np.float32)
            for t in tokens:
                v += np.random.default_rng(zlib.crc32(t.encode("utf-8", "replace"))).choice(np.array([-0.5, 0.5], np.float32), PATH_DIM)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def of(self, blocks: list[tuple[str, str, float]]) -> np.ndarray:
        x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + 3), np.float32)
        words = [t.split() for _, t, _ in blocks]
        for i, (path, t, link) in enumerate(blocks):
            x[i, :PATH_DIM] = self._path(path)
            x[i, -3:] = np.log1p(len(words[i])) / 4, link, t[-1] in ".!?…"
        n = np.array([len(w) for w in words])
        if len(self.words) > 300_000:
            self.words.clear()
        known = self.words
        h = np.fromiter((known.get(w) if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) % WORD_DIM) for ws in words for w in ws), np.int64, count=int(n.sum()))
        row = np.repeat(np.arange(len(blocks)), n)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(row * WORD_DIM + h, minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM) / np.maximum(n, 1)[:, None]
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """One bidirectional LSTM layer and a logistic unit per block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": rng.normal(0, 0.3, 2 * hidden).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1.0  # remember at first

    def _run(self, x: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        z_in, out = x @ self.p["x" + d] + self.p["c" + d], np.zeros((n, steps, k), np.float32)
        for t in range(steps):
            z = z_in[:, t] + h @ self.p["h" + d]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            before, h_before = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            if tape is not None:
                tape.append((i, f, o, g, before, th, h_before))
        return out

    @staticmethod
    def _turn(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each row's first ``n`` steps backwards; padding stays behind."""
        t = np.arange(x.shape[1])[None, :]
        at = np.where(t < n[:, None], n[:, None] - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], axis=1)

    def logits(self, x: np.ndarray, n: np.ndarray, tape: dict | None = None) -> np.ndarray:
        tf, tb = ([], []) if tape is not None else (None, None)
        back = self._turn(x, n)
        h = np.concatenate([self._run(x, "f", tf), self._turn(self._run(back, "b", tb), n)], axis=2)
        if tape is not None:
            tape.update(f=tf, b=tb, back=back, h=h)
        return h @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tape: dict = {}
        z = self.logits(x, n, tape)
        live = np.arange(x.shape[1])[None, :] < n[:, None]
        d = np.where(live, _sigmoid(z) - y, 0).astype(np.float32) / live.sum()
        grads = {"out": np.einsum("nt,nth->h", d, tape["h"]), "bias": np.array([d.sum()])}
        dh_all = d[:, :, None] * self.p["out"]
        k = self.hidden
        for name, inp, dh_seq in (("f", x, dh_all[:, :, :k]), ("b", tape["back"], self._turn(dh_all[:, :, k:], n))):
            dz_all, dh, dc = np.zeros((*x.shape[:2], 4 * k), np.float32), 0.0, 0.0
            gh = np.zeros_like(self.p["h" + name])
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, g, before, th, h_before = tape[name][t]
                dh = dh + dh_seq[:, t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gh += h_before.T @ dz
                dz_all[:, t] = dz
                dh, dc = dz @ self.p["h" + name].T, dc * f
            grads["h" + name] = gh
            grads["x" + name] = np.einsum("ntd,ntk->dk", inp, dz_all, optimize=True)
            grads["c" + name] = dz_all.sum(axis=(0, 1))
        return grads


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), int(n.max()), rows[0].shape[1]), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, n


def rearranged(blocks: list[tuple[str, str, float]], strangers: list[str], rng: np.random.Generator) -> list[tuple[str, str, float, bool]]:
    """A page's main texts under another layout, among other parts that hold texts of the same kind."""
    main = [(p.split(">")[-1].split(" ")[0] or "p", t) for p, t, _ in blocks if named_part(p)] or [("p", strangers[0])]
    names = sorted(OTHER)
    holder = rng.choice(["article", "main", "div .content", "div .post", "section .entry .content", "div .story", "div", "main>article", "div .page>div .text", "article>section", ""])
    outer = "html>body" + rng.choice(["", ">div", ">div .wrapper", ">div .page"])

    def other() -> list[tuple[str, str, float, bool]]:
        name = str(rng.choice(names))
        tag = name if name in ("nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select") and rng.random() < 0.7 else f"{rng.choice(['div', 'section', 'ul', 'aside', 'p'])} .{name}"
        if rng.random() < 0.3:
            tag += " ." + str(rng.choice(["left", "top", "box", "main", "container", "list", "item", "inner", "site", "page", "block"]))
        inside = str(rng.choice(["", ">p", ">ul>li", ">div>p", ">h", ">div", ">span"]))
        link = 1.0 if "li" in inside or rng.random() < 0.2 else 0.0
        take = lambda: (t := str(strangers[int(rng.integers(len(strangers)))]))[: len(t) if rng.random() < 0.5 else int(rng.integers(3, 60))].strip() or "x"
        deep = (outer + ">" + holder.strip(">")).rstrip(">") if rng.random() < 0.25 else outer
        return [(f"{deep}>{tag}{inside}", take(), link, False) for _ in range(int(rng.integers(1, 6)))]

    kinds = ["p", "h", "ul>li", "ul>li", "ul>li", "ol>li", "ol>li", "blockquote>p", "pre", "table>tr>td", "div", "div>p", "dl>dd", "figure>figcaption", "section>p"]
    body = []
    for tag, t in main:
        if rng.random() < 0.5:
            tag = str(rng.choice(kinds)) if rng.random() < 0.8 else "h" + str(rng.integers(1, 5))
            t = t[: int(rng.integers(3, 80))].strip() or t if rng.random() < 0.4 else t
        body.append(((outer + ">" + holder).rstrip(">") + ">" + tag, t, float(rng.random() < 0.05), True))
    cut = int(rng.integers(0, len(body) + 1))
    inner = other() if rng.random() < 0.4 else []
    before = [b for _ in range(int(rng.integers(0, 4))) for b in other()]
    after = [b for _ in range(int(rng.integers(0, 4))) for b in other()]
    return before + body[:cut] + inner + body[cut:] + after


def train_pages(pages: list[str], epochs: int = 16, rate: float = 0.01, seed: int = 6) -> BiLstm:
    rng, feats = np.random.default_rng(seed), Features()
    model = BiLstm(PATH_DIM + WORD_DIM + 3)
    whole = [b for p in pages if (b := leaf_blocks(p))]
    strangers = [t for b in whole for _, t, _ in b] or ["text"]
    labelled = [[(*x, named_part(x[0])) for x in b] for b in whole]
    labelled += [rearranged(b, strangers, rng) for b in whole for _ in range(COPIES)]
    labelled = [b[at : at + STRETCH] for b in labelled for at in range(0, len(b), STRETCH)]
    rows = [(feats.of([x[:3] for x in b]), np.array([x[3] for x in b], np.float32)) for b in labelled]
    m, v, step = {k: np.zeros_like(p) for k, p in model.p.items()}, {k: np.zeros_like(p) for k, p in model.p.items()}, 0
    for e in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            part = [rows[i] for i in order[lo : lo + 32]]
            x, n = _padded([r for r, _ in part])
            y = np.zeros(x.shape[:2], np.float32)
            for i, (_, own) in enumerate(part):
                y[i, : len(own)] = own
            step += 1
            for k, g in model.gradients(x, n, y).items():  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (1 - 0.9 * e / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(pages: DataFrame, sample: int = SAMPLE) -> BiLstm:
    """Model from the first ``sample`` pages in hash order. Only pages whose hash lies below four times the wanted share are ordered, by their hashes; html is fetched for the chosen ones."""
    src = pages.where(F.length("html") > 0).select("html", F.xxhash64("page_id", "url").alias("key"), F.xxhash64("html").alias("text"))
    n = src.count()
    near = src.where(F.col("key") / 2.0**64 + 0.5 <= 4.0 * sample / max(n, 1)) if n > 4 * sample else src
    chosen = materialize(near.select("key", "text").distinct().orderBy("key", "text").limit(sample), "training-pages")
    rows = near.join(chosen, ["key", "text"], "left_semi").dropDuplicates(["key", "text"]).orderBy("key", "text")
    return train_pages([r["html"] for r in rows.select("html").toLocalIterator()])


def label(model: BiLstm, feats: Features, pages: list[list[tuple[str, str, float]]]) -> list[np.ndarray]:
    """Main or not for every block of every page; pages of like length are read together."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    while order:
        size, k = 0, 0
        while k < len(order) and (k == 0 or (k + 1) * len(pages[order[k]]) <= CELLS):
            size, k = len(pages[order[k]]), k + 1
        x, n = _padded([feats.of(pages[i]) for i in order[:k]])
        z = model.logits(x, n)
        for i, row in zip(order[:k], z, strict=True):
            out[i] = row[: len(pages[i])] > 0
        order = order[k:]
    return out


def extract(pages: DataFrame, model: BiLstm) -> DataFrame:
    """All columns of ``pages`` but html plus ``text`` (main blocks joined by a space, empty if none) and ``n_chars``.

    A NULL page is an empty one. Whole pages are read, unclosed tags and comments run to the end. Repeated rows give equal results; an empty
    table gives an empty result; columns named like a new one are replaced.
    """
    rest = [c for c in pages.columns if c != "html" and c.lower() not in ("text", "n_chars")]
    src = pages.select(*[F.col(f"`{c}`") for c in rest], F.col("html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                cut = [leaf_blocks(h or "") for h in b.column(b.num_columns - 1).to_pylist()]
                texts = [" ".join(t for (_, t, _), ok in zip(c, main, strict=True) if ok) for c, main in zip(cut, label(model, feats, cut), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
