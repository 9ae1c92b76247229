"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block tags, each with its tag path. A bidirectional LSTM
in numpy reads, for the whole page, hashed vectors of the whole tag path and of all words of the blocks in order, with
the shares of the page's text that their containers hold, and labels every block as main text or not; the text is the
main blocks, joined by a space.

The labeller is trained on blocks of a bounded sample of pages of any length, labelled by the page's own semantic
containers (article or main against nav, header, footer, aside, form and the like), and on the same texts laid out anew
in other page shapes, with sidebars, notices, forms and reader comments. In those, containers lose their names at
random or have made-up ones, so that the labeller can't lean on them: words, links, order and shares of the text decide.
A sampled page in which no container tells the main text gives texts only. The sample is
chosen by the hash of page_id; of a page with more than ``DRAWN`` blocks it has ``RUNS`` runs of neighbours from
all over the page, and only their vectors reach the driver. Where no sampled page has a block there is nothing to
learn from, and blocks are labelled by their containers.

Defined results: a null or empty html gives an empty text; a page of any length is read as one sequence in both
directions (long ones in windows, with the states carried from one to the next); script, style, head, comments and other unseen elements are no blocks;
unclosed tags end with their container; a tag with an unclosed quote ends at its first ">"; repeated rows are extracted
each for itself.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that are never shown as text, that stay inside a block, and that have no end.
UNSEEN = frozenset("script style noscript template head title svg iframe object textarea select option button math canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
SIBLINGS = frozenset("li tr td th dd dt".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is skipped as it stands, up to their end tag.
RAW = frozenset("script style noscript template iframe textarea svg".split())
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_VALUE = re.compile(r"\s*=\s*")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")

PATH_SLOTS, WORD_SLOTS, SHAPES, SHARES = 64, 48, 6, 7
INPUT, HIDDEN = PATH_SLOTS + WORD_SLOTS + SHAPES + SHARES, 20
LENGTH, LINKED, PLACE = PATH_SLOTS + WORD_SLOTS, PATH_SLOTS + WORD_SLOTS + 1, PATH_SLOTS + WORD_SLOTS + 4
#: The inputs of a block's text, between those of its path and those of its container.
TEXT = slice(PATH_SLOTS, INPUT - SHARES)
#: Steps of a page that are worked on at once, and padded blocks in a batch of pages: both bound memory only.
WINDOW, BATCH_BLOCKS = 256, 80_000
#: Of a sampled page the labeller learns from so many blocks at most, drawn in so many runs.
DRAWN, RUNS = 192, 8


class Tags:
    """The tags of a page from left to right, each found once: (start, end, closing, name, attributes)."""

    def __init__(self, page: str) -> None:
        self.page, self.lower = page, None
        self.last_quote = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """The place after the ">" that ends a tag, as quoted values may have others; -1 if there is none."""
        page = self.page
        close = page.find(">", at)
        if close < 0:
            return -1
        double, single = page.count('"', at, close), page.count("'", at, close)
        if not single and not double % 2 or not double and not single % 2:
            return close + 1
        while True:
            equals, close = page.find("=", at), page.find(">", at)
            if close < 0:
                return -1
            if not 0 <= equals < close:
                return close + 1
            at = _VALUE.match(page, equals).end()
            quote = page[at : at + 1]
            if quote and quote in "\"'" and at < self.last_quote[quote]:
                at = page.index(quote, at + 1) + 1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, False, "", ""
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
                yield at, end, False, "", ""
            else:
                closing = page.startswith("/", at + 1)
                name = _NAME.match(page, at + 1 + closing)
                end = self._end(name.end()) if name else -1
                if not name or end < 0:
                    at += 1
                    if name and end < 0:
                        return  # no tag ends any more
                    continue
                tag = name[0].lower()
                yield at, end, closing, tag, page[name.end() : end - 1]
                if tag in RAW and not closing:
                    # What is inside goes up to the end tag, or to the end of the page.
                    self.lower = self.lower or page.lower()
                    inside, end = end, self.lower.find("</" + tag, end)
                    if end < 0:
                        end = len(page)
                    yield inside, end, False, "", ""
            at = end


class Path:
    """The tags open around a block, with their names, as a chain to the root: blocks share it, at any depth."""

    __slots__ = ("parent", "parts", "level", "end", "main", "size")

    def __init__(self, parent: Path | None, parts: tuple[str, ...]) -> None:
        self.parent, self.parts, self.size = parent, parts, 0.0
        self.level, self.end, own = (parent.level + 1, parent.end, parent.main) if parent else (0, 0, None)
        self.end += len(parts)
        #: 1 if the innermost telling container is one of main text, 0 if of other text, None if there is none.
        self.main = next((int(p in MAIN_PARTS) for p in reversed(parts) if p in OTHER_PARTS or p in MAIN_PARTS), own)


def blocks(page: str) -> list[tuple[Path | None, str, float]]:
    """(tag path, text, share of characters in links) of every leaf block with text, in page order."""
    stack: list[tuple[str, Path]] = []
    open_tags: Counter[str] = Counter()
    out: list[tuple[Path | None, str, float]] = []
    text: list[str] = []
    linked = [0, 0]  # characters in links, open links
    unseen = 0

    def end_block() -> None:
        words = " ".join(html_lib.unescape("".join(text)).split()) if text else ""
        if words:
            out.append((stack[-1][1] if stack else None, words, min(1.0, linked[0] / len(words))))
        text.clear()
        linked[0] = 0

    def say(raw: str) -> None:
        if raw and not unseen:
            text.append(raw)
            if linked[1]:
                linked[0] += len(raw)

    at = 0
    for start, end, closing, tag, attributes in Tags(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                linked[1] = 0
            if tag in INLINE:
                continue
            if open_tags[tag]:
                end_block()
                while stack:
                    t, _ = stack.pop()
                    open_tags[t] -= 1
                    unseen -= t in UNSEEN
                    if t == tag:
                        break
            continue
        if tag in INLINE:
            linked[1] = 1 if tag == "a" else linked[1]
            continue
        end_block()
        if tag in VOID:
            continue
        if tag == "body":
            unseen = 0
            stack.clear()
            open_tags.clear()
        # A new p or any block ends an open p; a new li ends the li before it, and so on.
        while stack and (stack[-1][0] == "p" or (tag in SIBLINGS and stack[-1][0] == tag)):
            open_tags[stack.pop()[0]] -= 1
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if "=" in attributes else ""
        stack.append((tag, Path(stack[-1][1] if stack else None, (tag, *("." + x for x in _PART.findall(named.lower()))))))
        open_tags[tag] += 1
        unseen += tag in UNSEEN
    say(page[at:])
    end_block()
    return out


class _Slots(dict):
    """word -> slot, kept for 100,000 words at most."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode()) % self.n
        return slot


_path_slots, _word_slots = _Slots(PATH_SLOTS), _Slots(WORD_SLOTS)


class PathVectors:
    """The path inputs of blocks in page order; only what changed since the block before is looked up."""

    def __init__(self) -> None:
        self.chain: list[Path] = []
        self.slots, self.weights = np.zeros(64, np.int64), 1.0 / (1 + 0.15 * np.arange(64))
        self.last = np.zeros(PATH_SLOTS)

    def __call__(self, path: Path | None) -> np.ndarray:
        if path is (self.chain[-1] if self.chain else None):
            return self.last
        new = []
        while path is not None and not (path.level < len(self.chain) and self.chain[path.level] is path):
            new.append(path)
            path = path.parent
        del self.chain[path.level + 1 if path is not None else 0 :]
        for node in reversed(new):
            if node.end > len(self.slots):
                self.slots = np.resize(self.slots, 2 * node.end)
                self.weights = 1.0 / (1 + 0.15 * np.arange(2 * node.end))
            self.slots[node.end - len(node.parts) : node.end] = [_path_slots[p] for p in node.parts]
            self.chain.append(node)
        n = self.chain[-1].end if self.chain else 0
        self.last = np.bincount(self.slots[:n][::-1], self.weights[:n], PATH_SLOTS)
        return self.last


def text_vector(text: str) -> np.ndarray:
    """What the text alone tells: the inputs after those of the path, with no links and no place yet."""
    words = text.lower().split(" ")
    x = np.empty(WORD_SLOTS + SHAPES, np.float32)
    x[:WORD_SLOTS] = np.bincount([_word_slots[w] for w in words], minlength=WORD_SLOTS) / len(words)
    x[WORD_SLOTS:] = (np.log1p(len(text)) / 8, 0.0, text[-1] in ".!?\"'", len(words) < 5, 0.0, 1.0)
    return x


def shares(paths: list[Path | None], sizes: np.ndarray) -> np.ndarray:
    """For each block what its containers hold of the page's text, whatever their names, and whether it is where the one before was."""
    nodes: dict[int, Path] = {}
    for path in paths:
        while path is not None and id(path) not in nodes:
            nodes[id(path)] = path
            path.size = 0.0
            path = path.parent
    for path, size in zip(paths, sizes.tolist(), strict=True):
        if path is not None:
            path.size += size
    order = sorted(nodes.values(), key=lambda p: -p.level)
    for p in order:
        if p.parent is not None:
            p.parent.size += p.size
    total = max(float(sizes.sum()), 1.0)
    # The innermost container that holds half of the page's text.
    core = next((p for p in order if 2 * p.size >= total), None)
    inside: dict[int, bool] = {}
    for p in reversed(order):
        inside[id(p)] = p is core or (p.parent is not None and inside[id(p.parent)])
    out = np.zeros((len(paths), SHARES), np.float32)
    before: Path | None = None
    for i, path in enumerate(paths):
        up = path.parent if path is not None else None
        over = up.parent if up is not None else None
        out[i, 0] = up.size / total if up is not None else 1.0
        out[i, 1] = over.size / total if over is not None else 1.0
        out[i, 2] = path is not None and inside[id(path)]
        if before is not None and path is not None:
            out[i, 3] = before.parent is up
            out[i, 4] = before.parent is not None and over is not None and before.parent.parent is over
            out[i, 5] = min(before.level - path.level, 4) / 4 if before.level > path.level else max(before.level - path.level, -4) / 4
        out[i, 6] = min(path.level, 12) / 12 if path is not None else 0.0
        before = path
    return out


def page_vectors(paths: list[Path | None], texts: list[np.ndarray], linked: list[float], sizes: np.ndarray) -> np.ndarray:
    """The input vector of every block, from its path, its text's vector, its share of links and its length."""
    x = np.zeros((len(paths), INPUT), np.float32)
    path_vector = PathVectors()
    for i, (path, text) in enumerate(zip(paths, texts, strict=True)):
        x[i, :PATH_SLOTS], x[i, TEXT] = path_vector(path), text
    if len(paths):
        x[:, LINKED], x[:, PLACE], x[:, INPUT - SHARES :] = linked, np.arange(len(paths)) / len(paths), shares(paths, sizes)
    return x


def vectors(page: list[tuple[Path | None, str, float]]) -> np.ndarray:
    """The input vector of every block."""
    return page_vectors([p for p, _, _ in page], [text_vector(t) for _, t, _ in page], [k for _, _, k in page], np.array([len(t) for _, t, _ in page], np.float64))


def drawn(n: int) -> np.ndarray:
    """Of n blocks at most ``DRAWN``: all, or runs evenly spread from the first block to the last."""
    if n <= DRAWN:
        return np.arange(n)
    run = DRAWN // RUNS
    return (np.linspace(0, n - run, RUNS).astype(int)[:, None] + np.arange(run)).ravel()


class BlockLstm:
    """A bidirectional LSTM with one logit a block, over padded batches (time, page, input)."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.w = {}
        for side in "fb":
            self.w[side] = (rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUT + HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.w[side + "b"] = bias
        self.w["o"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str) -> dict[str, np.ndarray]:
        steps, pages, _ = x.shape
        w, b = self.w[side], self.w[side + "b"]
        given = (x.reshape(-1, INPUT) @ w[:INPUT] + b).reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        kept = {k: np.zeros((steps, pages, n), np.float32) for k, n in (("h", HIDDEN), ("h0", HIDDEN), ("c", HIDDEN), ("c0", HIDDEN), ("gate", 4 * HIDDEN))}
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gate = given[t] + h @ w[INPUT:]
            gate[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-gate[:, : 3 * HIDDEN]))
            gate[:, 3 * HIDDEN :] = np.tanh(gate[:, 3 * HIDDEN :])
            i, f, o, g = np.split(gate, 4, axis=1)
            m = mask[t][:, None]
            kept["h0"][t], kept["c0"][t], kept["gate"][t] = h, c, gate
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            kept["c"][t], kept["h"][t] = c, h
        return kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict[str, dict[str, np.ndarray]]]:
        sides = {s: self._side(x, mask, s) for s in "fb"}
        return sides["f"]["h"] @ self.w["o"][:HIDDEN] + sides["b"]["h"] @ self.w["o"][HIDDEN:] + self.w["ob"][0], sides

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, sides = self.logits(x, mask)
        d = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0).astype(np.float32) / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["ob"][0] = d.sum()
        for n, side in enumerate("fb"):
            k, w = sides[side], self.w[side]
            own = slice(n * HIDDEN, (n + 1) * HIDDEN)
            grads["o"][own] = np.einsum("tp,tph->h", d, k["h"])
            dh, dc = np.zeros_like(k["h"][0]), np.zeros_like(k["c"][0])
            steps = range(len(x) - 1, -1, -1) if side == "f" else range(len(x))
            for t in steps:
                m = mask[t][:, None]
                dh = dh + d[t][:, None] * self.w["o"][own]
                i, f, o, g = np.split(k["gate"][t], 4, axis=1)
                tc = np.tanh(k["c"][t])
                dcc = dc + dh * o * (1 - tc**2)
                dgate = np.concatenate((dcc * g * i * (1 - i), dcc * k["c0"][t] * f * (1 - f), dh * tc * o * (1 - o), dcc * i * (1 - g**2)), axis=1)
                dgate = np.where(m, dgate, 0)
                grads[side][:INPUT] += x[t].T @ dgate
                grads[side][INPUT:] += k["h0"][t].T @ dgate
                grads[side + "b"] += dgate.sum(0)
                dh, dc = np.where(m, dgate @ w[INPUT:].T, dh), np.where(m, dcc * f, dc)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 8)
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            for b in rng.permutation(len(batches)):
                own = [pages[i] for i in batches[b]]
                x, mask = padded([p[0] for p in own])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(own):
                    y[: len(labels), k] = labels
                step += 1
                for k, g in self._gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _states(self, x: np.ndarray, mask: np.ndarray, side: str, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hidden states of one direction from h and c on, as ``_side`` gives them, and the last h and c."""
        steps, pages, _ = x.shape
        w, b = self.w[side], self.w[side + "b"]
        given = (x.reshape(-1, INPUT) @ w[:INPUT] + b).reshape(steps, pages, -1)
        recurrent = w[INPUT:]
        out = np.empty((steps, pages, HIDDEN), np.float32)
        full = mask.all(axis=1)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gate = h @ recurrent
            gate += given[t]
            opened = 1 / (1 + np.exp(-gate[:, : 3 * HIDDEN]))
            nc = opened[:, HIDDEN : 2 * HIDDEN] * c + opened[:, :HIDDEN] * np.tanh(gate[:, 3 * HIDDEN :])
            nh = opened[:, 2 * HIDDEN :] * np.tanh(nc)
            h, c = (nh, nc) if full[t] else (np.where(mask[t][:, None], nh, h), np.where(mask[t][:, None], nc, c))
            out[t] = h
        return out, h, c

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logits over whole sequences, as ``logits`` gives them; a window at a time."""
        z = np.full(mask.shape, self.w["ob"][0], np.float32)
        starts = range(0, len(x), WINDOW)
        for n, side in enumerate("fb"):
            h, c = (np.zeros((x.shape[1], HIDDEN), np.float32) for _ in range(2))
            for a in starts if side == "f" else reversed(starts):
                states, h, c = self._states(x[a : a + WINDOW], mask[a : a + WINDOW], side, h, c)
                z[a : a + WINDOW] += states @ self.w["o"][n * HIDDEN : (n + 1) * HIDDEN]
        return z

    def label(self, pages: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """True for main blocks, each by the whole page."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # Pages of like length go together, so that little is padded.
            most = 1.25 * len(pages[order[at]]) + 3
            own = [i for i in order[at : at + min(batch, max(1, int(BATCH_BLOCKS / most)))] if len(pages[i]) <= most]
            at += len(own)
            z = self.scores(*padded([pages[i] for i in own]))
            for k, i in enumerate(own):
                out[i] = z[: len(pages[i]), k] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


#: Path parts that name containers of main text, and of anything else.
MAIN_PARTS = frozenset(["article", "main", ".article", ".main", ".content", ".post", ".entry", ".story"])
OTHER_PARTS = frozenset(
    ["nav", "header", "footer", "aside", "form", "menu", "dialog"]
    + ".nav .navbar .menu .header .footer .sidebar .aside .widget .ad .ads .advert .advertisement .banner .promo .sponsored .cookie .notice .consent .popup .newsletter .subscribe .comments .comment .respond .share .social .related .breadcrumb .pagination .copyright".split()
)


def container_label(path: Path | None) -> int:
    """1 if the innermost telling container of a block is one of main text, however far out it is."""
    return (path.main or 0) if path is not None else 0


def page_labels(page: list[tuple[Path | None, str, float]]) -> np.ndarray:
    """Labels by the containers; -1 for the untold blocks of a page in which no container tells the main text."""
    told = np.array([-1 if p is None or p.main is None else p.main for p, _, _ in page], np.float32)
    return np.where(told < 0, 0, told) if (told == 1).any() else told


_SHELLS = (("body", "article"), ("body", "main"), ("body", "main", "article"), ("body", "div", ".content"), ("body", "div", ".wrapper", "div", ".post", ".entry"), ("body", "div", "div", ".main", "section"), ("body", "div", ".page", "article", ".story"), ("body", "div", ".article"), ("body", "section"), ("body", "div", "div"), ("body",))
_BEFORE = (("body", "nav", "ul", "li"), ("body", "header", "nav", "ul", "li"), ("body", "header"), ("body", "div", ".menu", "ul", "li"), ("body", "div", ".header"), ("body", "div", ".ad"), ("body", "div", ".banner"), ("body", "div", ".cookie", ".notice"), ("body", "div", ".notice", "p"), ("body", "aside", ".sidebar", "p"), ("body", "form"), ("body", "ul", ".breadcrumb", "li"), ("body", "div", "p"))
_AFTER = (("body", "footer"), ("body", "footer", "p"), ("body", "div", ".footer", "p"), ("body", "aside", "p"), ("body", "aside", ".sidebar", "ul", "li"), ("body", "div", ".sidebar", ".widget", "p"), ("body", "div", ".related", "ul", "li"), ("body", "div", ".ad"), ("body", "div", ".advertisement", "p"), ("body", "form", ".newsletter", "p"), ("body", "form", "p"), ("body", "div", ".share"))
_WITHIN = (("div", ".ad"), ("aside",), ("aside", "p"), ("div", ".advertisement", "p"), ("div", ".newsletter", "form"), ("div", ".share"), ("nav", "ul", "li"), ("footer",), ("header", "nav", "li"))
_COMMENTS = (("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "ul", "li"), ("div", ".comments", "div", ".comment", "p"), ("section", ".comments", "ol", "li", "p"), ("div", ".respond", "p"), ("div", ".comments", "article", ".comment", "p"), ("section", ".comments", "p"), ("div", ".comments", "p"))
_BODY_TAGS = ("p", "p", "p", "p", "p", "p", "h2", "li", "blockquote", "td", "h3", "div", "pre", "figcaption", "dd")
#: Texts that stand above or among reader comments.
_SAID = ("Comments", "3 comments", "Discussion", "Reply", "Leave a reply", "Posted by Anna", "Kommentare", "Commentaires", "Comentarios", "Responses (12)", "Log in to reply")


class _Page:
    """A page in the making: containers by their parts, with blocks in order."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        #: How often a named container loses its name or has a made-up one on this page.
        self.renamed = float(rng.choice([0.0, 0.5, 1.0]))
        self.names: dict[str, str] = {}
        self.paths: list[Path] = []
        self.texts: list[np.ndarray] = []
        self.linked: list[float] = []
        self.labels: list[int] = []

    def part(self, part: str) -> str | None:
        """The part as it is called on this page: main containers become plain ones, names are made up or left out."""
        if part not in self.names:
            self.names[part] = part
            if (part.startswith(".") or part in ("article", "main", "section")) and self.rng.random() < self.renamed:
                made_up = f".n{self.rng.integers(1 << 30)}"
                self.names[part] = ("" if self.rng.random() < 0.4 else made_up) if part.startswith(".") else "div" + (made_up if self.rng.random() < 0.7 else "")
        return self.names[part]

    def inside(self, path: Path | None, parts: tuple[str, ...]) -> Path | None:
        """A new chain of containers in ``path``; parts with a dot are names of the tag before them."""
        at = 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and parts[end].startswith("."):
                end += 1
            own = [x for p in parts[at:end] if (q := self.part(p)) for x in ([q] if q.startswith(".") or ".n" not in q else ["div", q[3:]])]
            path, at = Path(path, tuple(own)), end
        return path

    def add(self, path: Path, text: np.ndarray, linked: float, label: int) -> None:
        self.paths.append(path)
        self.texts.append(text)
        self.linked.append(linked)
        self.labels.append(label)

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.expm1(8 * np.array([t[WORD_SLOTS] for t in self.texts], np.float64))
        return page_vectors(self.paths, self.texts, self.linked, sizes), np.array(self.labels, np.float32)


def laid_out_anew(main: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a page of the same texts in a random shape, with its labels."""
    pick = lambda options: options[rng.integers(len(options))]
    texts = other[:, TEXT] if len(other) else text_vector("Menu")[None]
    bodies = main[:, TEXT] if len(main) else text_vector("Text.")[None]
    longer = bodies[bodies[:, WORD_SLOTS] > np.log1p(40) / 8]
    longer = longer if len(longer) else bodies
    page = _Page(rng)
    body = page.inside(None, ("body",))

    def around(root: Path, shapes: tuple, n: int) -> None:
        for _ in range(n):
            shape = tuple(p for p in pick(shapes) if p != "body")
            listed = shape[-1] == "li"
            home = page.inside(root, shape[:-1]) if len(shape) > 1 and not shape[-1].startswith(".") else root
            linked = listed and rng.random() < 0.8
            for _ in range(int(rng.integers(2, 8)) if listed else 1):
                # Notices and sidebars read like main text: only their place tells. Menus are short.
                text = pick(longer) if not listed and rng.random() < 0.4 else pick(texts)
                leaf = page.inside(home, shape[-1:]) if home is not root else page.inside(root, shape)
                page.add(leaf, text, float(linked), 0)

    def comments(root: Path) -> None:
        shape = pick(_COMMENTS)
        box = page.inside(root, shape[:2])
        if rng.random() < 0.5:
            page.add(page.inside(box, (pick(("h2", "h3", "h4", "div")),)), text_vector(pick(_SAID)), 0.0, 0)
        for _ in range(int(rng.integers(1, 7))):
            item = page.inside(box, shape[2:-1]) if len(shape) > 3 else box
            if rng.random() < 0.3:
                page.add(page.inside(item, (pick(("span", "div", "h4", "b")),)), text_vector(pick(_SAID)) if rng.random() < 0.5 else pick(texts), 0.0, 0)
            page.add(page.inside(item, shape[-1:]), pick(longer), 0.0, 0)

    around(body, _BEFORE, int(rng.integers(0, 5)))
    shell_parts = tuple(p for p in pick(_SHELLS) if p != "body")
    shell = page.inside(body, shell_parts)
    start = int(rng.integers(max(1, len(bodies) - 8)))
    chosen = bodies[start : start + int(rng.integers(1, 25))]
    within = 0.06 if rng.random() < 0.5 and shell_parts else 0.0
    for n, text in enumerate(chosen):
        tag = "h1" if n == 0 and rng.random() < 0.7 else pick(_BODY_TAGS) if rng.random() < 0.5 else "p"
        home = page.inside(shell, ("ul",) if tag == "li" else ("table", "tr") if tag == "td" else ()) if tag in ("li", "td") else shell
        page.add(page.inside(home, (tag,)), text, 0.0, 1)
        if rng.random() < within:
            around(shell, _WITHIN, 1)
    if rng.random() < 0.5:
        comments(shell if shell_parts and rng.random() < 0.3 else page.inside(body, ("div",)) if rng.random() < 0.2 else body)
    around(body, _AFTER, int(rng.integers(0, 5)))
    return page.vectors()


def train(pages: list[tuple[np.ndarray, np.ndarray]], *, layouts: int = 8, seed: int = 4) -> BlockLstm | None:
    """A labeller from the pages' (vectors, labels) and from ``layouts`` new shapes of each; none without blocks.

    Of a page with labels of -1 only texts are used: its longer blocks with few links are taken as main text.
    """
    rng = np.random.default_rng(seed)
    known = []
    for x, y in pages:
        if len(x):
            if (y >= 0).all() and (y > 0).any():
                known.append((x, y))
            body = y > 0 if (y > 0).any() else (y < 0) & (x[:, LENGTH] > np.log1p(60) / 8) & (x[:, LINKED] < 0.3)
            known += [laid_out_anew(x[body], x[~body], rng) for _ in range(layouts)]
    if not known:
        return None
    model = BlockLstm()
    model.fit(known, epochs=max(8, 240 // -(-len(known) // 64)))  # few pages are read more often: 240 steps at least
    return model


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors and container labels of the drawn blocks of each page."""
    for batch in batches:
        for page in batch.column(0):
            own = blocks(page.as_py())
            at = drawn(len(own))
            y = page_labels(own)[at]
            yield pa.RecordBatch.from_arrays([pa.array([vectors(own)[at].tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])


def extract(pages: DataFrame, *, html: str = "html", sample_pages: int = 300) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each page; the labeller learns from ``sample_pages`` pages at most.

    At most ``sample_pages`` * ``DRAWN`` vectors of ``INPUT`` floats (18 MB) reach the driver.
    """
    chosen = pages.where(F.length(html) > 0).select("page_id", F.col(html).alias("html"))
    ids = chosen.select(F.col("page_id").alias("s_id")).distinct().orderBy(F.xxhash64("s_id"), "s_id").limit(sample_pages)
    sample = chosen.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("s_id"))).groupBy("page_id").agg(F.min("html").alias("html"))
    rows = sorted((bytes(r.x), bytes(r.y)) for r in sample.select("html").mapInArrow(_draw, "x binary, y binary").collect())
    model = train([(np.frombuffer(x, np.float32).reshape(-1, INPUT), np.frombuffer(y, np.float32)) for x, y in rows])
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                cut = [blocks(h) if h else [] for h in part.column(2).to_pylist()]
                labels = model.label([vectors(b) for b in cut]) if model else [[container_label(p) for p, _, _ in b] for b in cut]
                texts = [" ".join(t for (_, t, _), main in zip(b, y, strict=True) if main) for b, y in zip(cut, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
