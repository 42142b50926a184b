"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks.  Each block is described by vectors
of its tag path (tags, classes, ids and roles of its ancestors, hashed) and of its
words (hashed), and a few shape features; a bidirectional LSTM in numpy reads the
whole sequence in both directions, so each block is labelled with the context of
the document, and the blocks labelled main are the text.  The network is trained
here, on pages composed from a grammar of layouts whose labels are known by
construction; it never sees the pages it is applied to.

Defined results
---------------
* Null, empty and blockless html gives the empty text.
* Character references are decoded as HTML5 says; white space (as Unicode defines it)
  inside a block becomes one space; blocks are trimmed and joined by one line feed;
  blocks that are empty then are no blocks.  ``br`` and cell borders inside a block
  count as white space or borders of blocks.
* Unclosed comments, tags and raw-text elements run to the end of the page.
* Pages of any length are labelled whole; repeated rows are labelled each.  Extra
  columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import give_back, table

PATH_BUCKETS, WORD_BUCKETS = 2048, 1024
PATH_SIZE, WORD_SIZE, SHAPE_SIZE, HIDDEN = 24, 6, 6, 20
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 2000, 4, 32, 0.01, 1
#: Pages that are labelled together: so many at most, and so many steps x pages (one page may have more steps).
PAGE_GROUP, CELLS = 128, 1 << 16

# Elements of HTML that do not end a block, that hold no text, and that have no end tag.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = "script|style|noscript|template|iframe|svg|canvas|object|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/])[^>]*/>|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAME = re.compile(r"[A-Za-z]+")
#: Start tags that end an open element of the same kind.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class _Hashes(dict):
    """Word to bucket; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = at = _crc(word.lower()) % WORD_BUCKETS
        return at


_buckets = _Hashes()


@lru_cache(maxsize=100_000)
def _path_tokens(tag: str, attributes: str) -> tuple[int, ...]:
    names = [tag]
    for kind, value in _ATTRIBUTE.findall(attributes):
        mark = "#" if kind.lower() == "id" else "." if kind.lower() == "class" else "@"
        words = [w.lower() for w in _NAME.findall(value)]
        names += [mark + "".join(words), *words] if len(words) > 1 else [mark + w for w in words] + words
    return tuple(_crc(n) % PATH_BUCKETS for n in names)


class Path:
    """A tag path: the hashed tokens of one element, and the path around it; blocks share what their paths share."""

    __slots__ = ("around", "tokens", "size", "depth")

    def __init__(self, around: Path | None, tokens: tuple[int, ...]):
        self.around, self.tokens = around, tokens
        self.size = len(tokens) + (around.size if around else 0)
        self.depth = around.depth + 1 if around else 0


Block = tuple[str, Path, int]
ROOT = Path(None, ())


def leaf_blocks(page: str) -> list[Block]:
    """(text, tag path, characters inside links) of every leaf block, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, Path]] = [("", ROOT)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link_start = 0, -1
    seen = 0

    def flush() -> None:
        nonlocal linked, seen, link_start
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inside = linked + (seen - link_start if link_start >= 0 else 0)
                blocks.append((text, stack[-1][1], min(inside, len(text))))
            parts.clear()
        linked, seen = 0, 0
        link_start = 0 if link_start >= 0 else -1

    at = 0
    for found in _TOKEN.finditer(page):
        start = found.start()
        if start > at:
            text = html.unescape(page[at:start])
            parts.append(text)
            seen += len(text)
        at = found.end()
        tag = found[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                if found[2]:
                    linked += seen - link_start if link_start >= 0 else 0
                    link_start = -1
                else:
                    link_start = seen
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if found[2]:
            inner = "" if opened[tag] else tag  # an end without a start ends nothing
            while inner != tag:
                inner = stack.pop()[0]
                opened[inner] -= 1
        else:
            while stack[-1][0] in _CLOSES.get(tag, ()):
                opened[stack.pop()[0]] -= 1
            if tag not in VOID and not found[4].endswith("/"):
                stack.append((tag, Path(stack[-1][1], _path_tokens(tag, found[4]))))
                opened[tag] += 1
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return blocks


def _shape(block: Block, place: int, n: int) -> tuple[float, ...]:
    text, _, linked = block
    size = len(text)
    return (
        np.log1p(size) / 5, linked / size, min(1.0, sum(map(text.count, ".,;:!?")) * 10 / size), place / n, np.log1p(n) / 5, min(1.0, 20 / size),
    )


# --- the network ---------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.maximum(x, -60)))


class PathTree:
    """The distinct elements of many tag paths: vectors are summed once an element, not once a block and element."""

    def __init__(self, paths: list[Path]):
        at: dict[int, int] = {}
        nodes: list[Path] = []
        for path in paths:
            new = []
            while path is not None and id(path) not in at:
                new.append(path)
                at[id(path)] = -1
                path = path.around
            for path in reversed(new):
                at[id(path)] = len(nodes)
                nodes.append(path)
        self.leaf = np.array([at[id(p)] for p in paths])
        self.around = np.array([at[id(p.around)] if p.around else -1 for p in nodes])
        sizes = np.array([len(p.tokens) for p in nodes])
        self.tokens = np.array([t for p in nodes for t in p.tokens], np.int32)
        self.node_of = np.repeat(np.arange(len(nodes)), sizes)
        self.full, self.first = sizes > 0, (np.cumsum(sizes) - sizes)[sizes > 0]
        depth = np.array([p.depth for p in nodes])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """The sum of the vectors of all tokens of each path."""
        out = np.zeros((len(self.around), vectors.shape[1]), vectors.dtype)
        if len(self.tokens):
            out[self.full] = np.add.reduceat(vectors[self.tokens], self.first, 0)
        for level in self.levels[1:]:
            out[level] += out[self.around[level]]
        return out[self.leaf]

    def slopes(self, d: np.ndarray) -> np.ndarray:
        """Gradients of the token vectors from those of the paths' sums."""
        nodes, out = np.zeros((len(self.around), d.shape[1]), d.dtype), np.zeros((PATH_BUCKETS, d.shape[1]), d.dtype)
        np.add.at(nodes, self.leaf, d)
        for level in self.levels[:0:-1]:
            np.add.at(nodes, self.around[level], nodes[level])
        np.add.at(out, self.tokens, nodes[self.node_of])
        return out


class Labeller:
    """Embedding sums, a bidirectional LSTM and a logistic output; all in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype("f4")
        size = PATH_SIZE + WORD_SIZE + SHAPE_SIZE
        self.w = {"path": draw(PATH_BUCKETS, PATH_SIZE), "word": draw(WORD_BUCKETS, WORD_SIZE), "out": draw(2 * HIDDEN, 1), "bias": np.zeros(1, "f4")}
        for way in "fb":
            self.w[way] = draw(size + HIDDEN, 4 * HIDDEN)
            self.w[way + "0"] = np.zeros(4 * HIDDEN, "f4")
            self.w[way + "0"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, pages: list[list[Block]]) -> tuple[np.ndarray, tuple]:
        """(blocks, features) over all blocks of non-empty pages, and what the gradients of the vectors need."""
        blocks = [(b, n, len(page)) for page in pages for n, b in enumerate(page)]
        tree = PathTree([b[1] for b, _, _ in blocks])
        path_n = np.array([b[1].size for b, _, _ in blocks])
        words = [b[0].split() for b, _, _ in blocks]
        word_n = np.array([len(w) for w in words])
        hashed = np.fromiter((_buckets[w] for line in words for w in line), np.int32, int(word_n.sum()))
        word_at = np.repeat(np.arange(len(blocks)), word_n)
        x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + SHAPE_SIZE), "f4")
        scale = 1 / np.sqrt(np.maximum(1, path_n))[:, None]
        x[:, :PATH_SIZE] = tree.sums(self.w["path"]) * scale
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.add.reduceat(self.w["word"][hashed], np.cumsum(word_n) - word_n, 0) * (2 / word_n)[:, None]
        x[:, PATH_SIZE + WORD_SIZE :] = [_shape(*b) for b in blocks]
        return x, (tree, scale, hashed, word_at, 2 / word_n)

    def run(self, way: str, x: np.ndarray, active: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Hidden states of a padded (time, page, feature) array; pages by falling length."""
        steps, n, _ = x.shape
        out = np.zeros((steps, n, HIDDEN), "f4")
        h, c = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4")
        w, b = self.w[way], self.w[way + "0"]
        ahead = x @ w[: x.shape[2]] + b
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            k = active[t]
            gates = ahead[t, :k] + h[:k] @ w[x.shape[2] :]
            i, f, o = (_sigmoid(gates[:, n_ * HIDDEN : (n_ + 1) * HIDDEN]) for n_ in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before_c, before_h = c[:k].copy(), h[:k].copy()
            c[:k] = f * before_c + i * g
            tanh_c = np.tanh(c[:k])
            h[:k] = o * tanh_c
            out[t, :k] = h[:k]
            if tape is not None:
                tape.append((t, k, i, f, o, g, before_c, before_h, tanh_c))
        return out

    @staticmethod
    def layout(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pages by falling length: (order, active pages a step, time and column of each block in page order)."""
        sizes = np.array([len(p) for p in pages])
        order = np.argsort(-sizes, kind="stable")
        column = np.empty(len(pages), int)
        column[order] = np.arange(len(pages))
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
        time = np.concatenate([np.arange(s) for s in sizes])
        return order, active, time, np.repeat(column, sizes)

    def chances(self, pages: list[list[Block]], tape: dict | None = None) -> np.ndarray:
        """Chance of every block of non-empty pages to be main text."""
        x, parts = self.inputs(pages)
        _, active, time, column = self.layout(pages)
        grid = np.zeros((len(active), len(pages), x.shape[1]), "f4")
        grid[time, column] = x
        tapes = ([], []) if tape is not None else (None, None)
        states = np.concatenate((self.run("f", grid, active, tapes[0]), self.run("b", grid, active, tapes[1])), 2)[time, column]
        p = _sigmoid((states @ self.w["out"])[:, 0] + self.w["bias"])
        if tape is not None:
            tape |= {"x": x, "parts": parts, "time": time, "column": column, "grid": grid, "tapes": tapes, "states": states}
        return p

    def slopes(self, p: np.ndarray, gold: np.ndarray, tape: dict) -> dict[str, np.ndarray]:
        d = ((p - gold) / len(gold)).astype("f4")[:, None]
        out = {"out": tape["states"].T @ d, "bias": d.sum(0)}
        grid, time, column = tape["grid"], tape["time"], tape["column"]
        d_states = np.zeros(grid.shape[:2] + (2 * HIDDEN,), "f4")
        d_states[time, column] = d @ self.w["out"].T
        d_grid, size = np.zeros_like(grid), grid.shape[2]
        for way, records, part in (("f", tape["tapes"][0], slice(0, HIDDEN)), ("b", tape["tapes"][1], slice(HIDDEN, None))):
            w = self.w[way]
            d_h, d_c = np.zeros((grid.shape[1], HIDDEN), "f4"), np.zeros((grid.shape[1], HIDDEN), "f4")
            d_w, d_b = np.zeros_like(w), np.zeros(4 * HIDDEN, "f4")
            for t, k, i, f, o, g, before_c, before_h, tanh_c in reversed(records):
                dh = d_h[:k] + d_states[t, :k, part]
                dc = d_c[:k] + dh * o * (1 - tanh_c**2)
                d_gates = np.concatenate((dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)), 1)
                d_w[:size] += grid[t, :k].T @ d_gates
                d_w[size:] += before_h.T @ d_gates
                d_b += d_gates.sum(0)
                d_grid[t, :k] += d_gates @ w[:size].T
                d_h[:k], d_c[:k] = d_gates @ w[size:].T, dc * f
            out[way], out[way + "0"] = d_w, d_b
        d_x = d_grid[time, column]
        tree, path_scale, words, word_at, word_scale = tape["parts"]
        out["path"], out["word"] = tree.slopes(d_x[:, :PATH_SIZE] * path_scale), np.zeros_like(self.w["word"])
        np.add.at(out["word"], words, d_x[word_at, PATH_SIZE : PATH_SIZE + WORD_SIZE] * word_scale[word_at, None])
        return out

    def fit(self, pages: list[list[Block]], labels: list[list[bool]], epochs: int = EPOCHS, rate: float = RATE) -> Labeller:
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        order, updates, shuffle = list(range(len(pages))), 0, random.Random(SEED)
        all_updates = epochs * -(-len(order) // BATCH)
        for _ in range(epochs):
            shuffle.shuffle(order)
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                tape: dict = {}
                p = self.chances([pages[n] for n in part], tape)
                gold = np.array([y for n in part for y in labels[n]], "f4")
                updates += 1
                for k, slope in self.slopes(p, gold, tape).items():
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.01 * (slope**2 - second[k])
                    self.w[k] -= rate * (1.02 - updates / all_updates) * first[k] / (1 - 0.9**updates) / (np.sqrt(second[k] / (1 - 0.99**updates)) + 1e-6)
        return self


# --- training pages ------------------------------------------------------------------------------

#: Wrappers of main text and of everything else: the vocabulary of the page grammar.
MAIN = (
    "article", "article", "article class=post", "main", "main id=content", "div class=content", "div id=content", "div class=entry-content",
    "div class=post-content", "div class=article-body", "section class=story", "div itemprop=articleBody class=body", "div role=main",
    "div class=post", "div class=text", "section class=entry", "div id=main", "div class=markdown",
)
OTHER = {
    "menu": ("nav", "nav class=menu", "ul class=menu", "div class=navbar", "div id=nav", "div role=navigation", "ul class=nav", "div class=breadcrumbs", "div class=topbar", "div class=pagination"),
    "header": ("header", "header class=site-header", "div id=header", "div class=header", "div class=masthead", "div role=banner", "div class=logo"),
    "footer": ("footer", "footer class=site-footer", "div id=footer", "div class=footer", "div role=contentinfo", "div class=copyright"),
    "sidebar": ("aside", "aside class=sidebar", "div class=sidebar", "div id=sidebar", "div role=complementary", "div class=widget", "div class=related", "section class=related-posts", "div class=recommended", "div class=tags"),
    "notice": ("div class=notice", "div class=cookie-notice", "div id=cookie-banner", "div class=consent", "div role=alert", "div class=alert", "div class=popup", "div class=modal", "div role=dialog", "div class=gdpr", "p class=notice", "div class=warning", "div class=message", "section class=notice"),
    "advert": ("div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id=ad", "aside class=ad", "div class=sponsored", "div class=banner", "div class=promo", "ins class=adsbygoogle", "section class=advert", "p class=ad"),
    "form": ("form", "form class=search", "form id=login", "div class=newsletter", "div class=subscribe", "form class=contact", "div class=search", "fieldset", "div class=login"),
    "comments": ("div class=comments", "section id=comments", "section class=comments", "div id=comments", "div class=comment", "ol class=comment-list", "ul class=comments", "div class=reader-comments", "div id=disqus", "div class=replies", "article class=comment", "div class=discussion"),
    "share": ("div class=share", "div class=social", "ul class=social-links", "div class=byline-tools"),
}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ung ein lich keit que eau tre ción mente ado é è ñ ü ö ß ç".split()
_STOCK = {
    "notice": "we use cookies to improve your experience accept all privacy policy", "form": "subscribe email password sign in search send name",
    "footer": "© copyright all rights reserved · terms privacy contact", "comments": "reply says posted ago like report", "advert": "advertisement sponsored buy now sale offer",
    "menu": "home about contact news products blog", "share": "share tweet print email", "sidebar": "related popular recent archives tags", "header": "logo skip to content site",
}
#: Common words, which tell nothing about a block.
_COMMON = (
    "the of and to in a is that for it as was with be by on not he are this at from but have an they or which one you all "
    "der die das und mit von le la les et des un une que el los las de en con por para"
).split()


class PageGrammar:
    """Random pages with the label of every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, kind: str = "") -> str:
        r, stock = self.r, _STOCK.get(kind, "").split()
        out = []
        for _ in range(n):
            x = r.random()
            if x < 0.25:
                out.append(r.choice(_COMMON))
            elif x < 0.28:
                out.append(r.choice(_STOCK[r.choice(list(_STOCK))].split()))
            elif stock and x < 0.6:
                out.append(r.choice(stock))
            else:
                out.append("".join(r.choices(_SYLLABLES, k=r.randint(1, 5))))
        style = r.random() if not kind else 1.0
        if style < 0.05:  # odd prose: one word over and over, shouting, or decorated words
            out = [out[0]] * r.randint(1, 60)
        elif style < 0.1:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.15:
            out = [w + r.choice(("***", "###", "%%%", "$$$", "&amp;&amp;")) for w in out]
        text = (" | " if 0.15 <= style < 0.22 else " ").join(w + (r.choice(".,") if r.random() < 0.12 else "") for w in out)
        return text[:1].upper() + text[1:] + r.choice(("", ".", "."))

    def tag(self, wrapper: str, inner: str) -> str:
        name, *rest = wrapper.split()
        attributes = "".join(f' {k}="{v}"' for k, v in (x.split("=") for x in rest))
        if self.r.random() < 0.15 and not rest:
            attributes = f' class="{"".join(self.r.choices(_SYLLABLES[:20], k=2))}"'
        return f"<{name}{attributes}>{inner}</{name}>"

    def other(self, kind: str) -> str:
        r, wrapper = self.r, self.r.choice(OTHER[kind])
        if kind in ("menu", "share", "sidebar", "footer") and r.random() < 0.75:
            links = [f'<a href="/x">{self.words(r.randint(1, 3), kind)}</a>' for _ in range(r.randint(2, 8))]
            inner = "".join(f"<li>{x}</li>" for x in links) if "ul" in wrapper.split() else "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
            inner += self.words(r.randint(3, 12), kind) if kind == "footer" else ""
        elif kind == "form":
            inner = f"<label>{self.words(2, kind)}</label><input type=text>" + f"<button>{self.words(1, kind)}</button>" * r.randint(0, 1) + f"<p>{self.words(r.randint(2, 12), kind)}</p>" * r.randint(0, 1)
        elif kind == "comments":
            inner = f"<h3>{self.words(2, kind)}</h3>" * r.randint(0, 1)
            for _ in range(r.randint(1, 6)):
                body = self.words(r.randint(3, 60), kind if r.random() < 0.5 else "")
                inner += r.choice(("<p>{}</p>", "<div class=\"comment\"><b>x</b> <p>{}</p></div>", "<li>{}</li>", "<div>{}</div>")).format(body)
        else:
            body = self.words(r.randint(1, 40), kind if r.random() < 0.6 else "")
            inner = body if r.random() < 0.5 else f"<p>{body}</p>"
            inner = f"<h1>{self.words(2)}</h1>" + inner if kind == "header" and r.random() < 0.4 else inner
        return self.tag(wrapper, inner)

    def main(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(r.randint(2, 10))}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            x = r.random()
            size = r.choice((1, 2, 4, 10, 30, 80, 150))
            if x < 0.7:
                out.append(f"<p>{self.words(size)}</p>")
            elif x < 0.76:
                out.append(f"<p><b>{self.words(size)}<br>")
            elif x < 0.82:
                out.append(f"<h2>{self.words(r.randint(1, 8))}</h2>")
            elif x < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.words(r.randint(1, 15))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.92:
                out.append(f"<blockquote><p>{self.words(size)}</p></blockquote>")
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(f"<pre>{self.words(size)}</pre>")
        return out

    def page(self) -> tuple[list[Block], list[bool]]:
        """Blocks and labels; the label of a block is marked in its text and taken out again."""
        r = self.r
        mark = lambda text, kind: re.sub(r">([^<]*\w[^<]*)", lambda m: f">{kind}{m[1]}" if m[1].strip() else m[0], text)
        pick = lambda kinds, p: [mark(self.other(k), "\x02") for k in kinds if r.random() < p]
        parts = [mark(x, "\x01") for x in self.main()]
        for extra in pick(("advert", "share", "form", "notice", "sidebar", "menu"), 0.12):
            parts.insert(r.randint(0, len(parts)), extra)
        if r.random() < 0.2:
            parts += pick(("comments", "sidebar", "footer"), 0.5)
        plain = r.random() < 0.12
        body = "".join(parts)
        if not plain:
            body = self.tag(r.choice(MAIN), body)
        if r.random() < 0.4:
            body = f"<div>{body}</div>"
        before = pick(("header", "menu", "notice", "advert", "form", "sidebar"), 0.4)
        after = pick(("comments", "sidebar", "advert", "form", "share", "notice", "menu", "footer"), 0.4)
        r.shuffle(before)
        whole = "<body>" + "".join(before) + body + "".join(after) + "</body></html>"
        blocks, labels = [], []
        for text, path, linked in leaf_blocks(whole):
            if "\x01" in text or "\x02" in text:
                labels.append(text.count("\x01") > text.count("\x02"))
                clean = text.replace("\x01", "").replace("\x02", "")
                blocks.append((clean, path, min(linked, len(clean))))
        return blocks, labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    grammar = PageGrammar(seed)
    made = [x for x in (grammar.page() for _ in range(pages)) if x[0]]
    return Labeller(seed).fit([b for b, _ in made], [y for _, y in made], epochs)


def main_texts(pages: list[str | None], labeller: Labeller) -> list[tuple[str, int, int]]:
    """(text, blocks, main blocks) of each page."""
    split = [leaf_blocks(p) if p else [] for p in pages]
    out = [("", 0, 0)] * len(pages)
    order = sorted((n for n, blocks in enumerate(split) if blocks), key=lambda n: -len(split[n]))
    while order:
        # the longest page of a group sets its steps
        take = max(1, min(PAGE_GROUP, CELLS // len(split[order[0]])))
        group, order = order[:take], order[take:]
        chances, at = labeller.chances([split[n] for n in group]).tolist(), 0
        for n in group:
            blocks = split[n]
            main = [b[0] for b, p in zip(blocks, chances[at : at + len(blocks)], strict=True) if p >= 0.5]
            at += len(blocks)
            out[n] = ("\n".join(main), len(blocks), len(main))
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row of ``pages``."""
    made = labeller or trained()
    shipped = pages.sparkSession.sparkContext.broadcast(made)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGE_GROUP):
                part = batch.slice(at, PAGE_GROUP)
                rows = main_texts(part.column(2).to_pylist(), shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([t for t, _, _ in rows], pa.string()), pa.array([len(t) for t, _, _ in rows], pa.int64()),
                        pa.array([n for _, n, _ in rows], pa.int32()), pa.array([n for _, _, n in rows], pa.int32()),
                    ],
                    names=[id_col, "url", "text", "n_chars", "n_blocks", "n_main"],
                )
        _buckets.clear()
        give_back()

    return pages.select(F.col(id_col).cast("long"), "url", html_col).mapInArrow(
        read, f"{id_col} long, url string, text string, n_chars long, n_blocks int, n_main int"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
