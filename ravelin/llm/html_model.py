"""A recurrent block labeller in numpy: a bidirectional LSTM over a page's
leaf blocks, trained on pages that are made here."""

from __future__ import annotations

import html
import zlib
from functools import lru_cache

import numpy as np

from ravelin.llm.html_blocks import Block, Node, blocks

PATH_DIM = 256
WORD_DIM = 96
EXTRA = 8
DIM = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 20
PAGES = 1200
EPOCHS = 8
BATCH = 24
SEED = 11
#: Blocks whose vectors are in memory as one array; the states of both directions are handed on from stretch to stretch.
STRETCH = 512


# Features


@lru_cache(maxsize=50_000)
def _bucket(kind: str, key: str, dim: int) -> int:
    return zlib.crc32(f"{kind}:{key}".encode("utf-8", "surrogatepass")) % dim


_WORDS: dict[str, int] = {}


def _word_bucket(word: str) -> int:
    b = _WORDS.get(word)
    if b is None:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        b = _WORDS[word] = zlib.crc32(word.lower().strip(".,;:!?()[]\"'").encode("utf-8", "surrogatepass")) % WORD_DIM
    return b


def _path_base(node: Node | None) -> np.ndarray:
    """Of all elements of a path: tags, pairs of tags and marks. Kept at the
    elements, so that each one is looked at once."""
    chain = []
    while node is not None and node.features is None:
        chain.append(node)
        node = node.parent
    base = np.zeros(PATH_DIM, np.float32) if node is None else node.features
    for n in reversed(chain):
        base = base.copy()
        base[_bucket("tag", n.tag, PATH_DIM)] = 1
        base[_bucket("pair", f"{n.parent.tag if n.parent else ''}>{n.tag}", PATH_DIM)] = 1
        for m in n.marks:
            base[_bucket("mark", m, PATH_DIM)] = 1
        n.features = base
    return base


def _path_vector(node: Node | None) -> np.ndarray:
    v = _path_base(node).copy()
    if node is None:
        return v
    v[_bucket("last", node.tag, PATH_DIM)] = 1
    if node.nearest is not None:
        v[_bucket("nearest", node.nearest.tag, PATH_DIM)] = 1
        for m in node.nearest.marks:
            v[_bucket("nearest", m, PATH_DIM)] = 1
    return v


def vectors(page: list[Block]) -> np.ndarray:
    """A row of features a block."""
    out = np.zeros((len(page), DIM), np.float32)
    seen: dict = {}
    for i, b in enumerate(page):
        if id(b.path) not in seen:  # blocks of one element stand together, and the page holds its elements
            seen[id(b.path)] = _path_vector(b.path)
        out[i, :PATH_DIM] = seen[id(b.path)]
        words = b.text.split()
        counts = np.bincount(np.fromiter(map(_word_bucket, words), np.int64, len(words)), minlength=WORD_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt((counts**2).sum())
        n = len(b.text)
        out[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 4,
            min(1.0, b.linked / n),
            float(b.text[-1] in ".!?:;\"”"),
            min(1.0, 8 * sum(map(b.text.count, ".,;")) / n),
            float(i == 0),
            (b.path.depth if b.path else 0) / 8,
            float("©" in b.text or "·" in b.text),
            float(b.path is not None and b.path.hidden),
        )
    return out


# Network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Weights by name: w and u and b for each direction, and the output's."""

    def __init__(self, rng):
        k = 1 / np.sqrt(HIDDEN)
        self.p = {}
        for d in ("f", "r"):
            self.p[f"w{d}"] = rng.uniform(-k, k, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.uniform(-k, k, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.p["v"] = rng.uniform(-k, k, (2 * HIDDEN, 1)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, start=None):
        """States of one direction over (steps, pages, features), from ``start``
        (h and c) or zero, and where they end; masked steps hand the state on."""
        h, c = start or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        pre = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        states, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ self.p[f"u{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h = m * (o * tc) + (1 - m) * h
            c = m * c_new + (1 - m) * c
            states[t] = h
        return states, tape, (h, c)

    def logits(self, pages: list[np.ndarray]) -> np.ndarray:
        """Of whole pages, (steps, pages): each direction reads stretch by
        stretch and hands its state on."""
        starts = range(0, max(map(len, pages)), STRETCH)
        both = np.zeros((max(map(len, pages)), len(pages), 2 * HIDDEN), np.float32)
        for k, d in enumerate(("f", "r")):
            at = None
            for a in starts if d == "f" else reversed(starts):
                states, _, at = self._run(*_padded([p[a : a + STRETCH] for p in pages]), d, False, at)
                both[a : a + len(states), :, k * HIDDEN : (k + 1) * HIDDEN] = states
        return (both @ self.p["v"])[..., 0] + self.p["c"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        runs = {d: self._run(x, mask, d, True) for d in ("f", "r")}
        both = np.concatenate([runs["f"][0], runs["r"][0]], axis=2)
        delta = ((_sigmoid((both @ self.p["v"])[..., 0] + self.p["c"][0]) - y) * mask / np.sqrt(mask.sum(axis=0) * mask.sum() / mask.shape[1]) / mask.shape[1])[..., None]
        g = {"v": (both * delta).sum(axis=(0, 1))[:, None], "c": delta.sum(axis=(0, 1))}
        out = delta @ self.p["v"].T
        for k, d in enumerate(("f", "r")):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            u = self.p[f"u{d}"]
            gu = np.zeros_like(u)
            dh_next = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc_next = np.zeros_like(dh_next)
            for t, h, c, i, f, o, gg, tc, m in reversed(runs[d][1]):
                dh_all = out[t][:, k * HIDDEN : (k + 1) * HIDDEN] + dh_next
                dh, dc = dh_all * m, dc_next * m
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                gu += h.T @ dz
                dh_next = dz @ u.T + dh_all * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
            g[f"u{d}"] = gu
            g[f"w{d}"] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            g[f"b{d}"] = dz_all.sum(axis=(0, 1))
        return g


def _padded(pages: list[np.ndarray]):
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), DIM), np.float32)
    mask = np.zeros((n, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def label(model: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Is each block main text, for each page; pages of like length go together."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < min(64, len(order)) and len(pages[order[n]]) * (n + 1) <= 64 * STRETCH:
            n += 1
        part, order = order[:n], order[n:]
        got = model.logits([pages[k] for k in part]) > 0
        for j, k in enumerate(part):
            out[k][:] = got[: len(pages[k]), j]
    return out


# Training pages

_SYLLABLES = "ka lo mi ren tas vel dor in an ethe ous par quin sol tre und vor wex yul zan bri cho dra fel gli hom jas ner pol".split()
_BOILER = {
    "menu": "Home About Contact News Blog Archive Login Register Search Shop Products Services Help Support Topics Sports Business".split(),
    "foot": ["Copyright 2024", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Powered by", "Sitemap", "Newsletter"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "By continuing you agree to our policy.", "Please enable JavaScript.", "Subscribe to our newsletter", "You have 3 free articles left."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50 %", "Special offer", "Click here", "Limited time only", "Download the app"],
    "side": ["Related articles", "Most read", "Popular posts", "Recent posts", "Tags", "Share this", "Follow us", "Read more", "Trending", "Categories"],
    "comment": ["Comments", "Leave a comment", "Reply", "says:", "posted on", "Log in to reply", "Great post, thanks!", "I do not agree with this.", "Report"],
    "form": ["Email address", "Password", "Send", "Your name", "Submit", "Sign up", "Search", "Message"],
}
_MAIN = (("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "article"), ("div", "main-content"), ("div", "text"))
_OTHER = {
    "menu": (("nav", ""), ("div", "nav"), ("ul", "menu"), ("div", "menu"), ("nav", "main-nav"), ("div", "breadcrumb"), ("header", ""), ("div", "navbar")),
    "foot": (("footer", ""), ("div", "footer"), ("div", "bottom copyright")),
    "notice": (("div", "cookie"), ("div", "notice"), ("div", "banner"), ("div", "alert"), ("aside", "notice"), ("div", "popup"), ("div", "cookie-notice"), ("div", "consent")),
    "ad": (("div", "ad"), ("div", "ads"), ("aside", "advert"), ("div", "sponsor"), ("div", "advertisement"), ("section", "promo"), ("div", "banner ad")),
    "side": (("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "widget"), ("aside", "sidebar"), ("div", "share social")),
    "comment": (("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "comment"), ("section", "reader-comments"), ("div", "discussion")),
    "form": (("form", ""), ("form", "search"), ("form", "login"), ("form", "newsletter")),
}


def _word(rng) -> str:
    return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))


def _sentence(rng, least: int = 1, most: int = 18) -> str:
    words = [_word(rng) for _ in range(int(rng.integers(least, most)))]
    return " ".join(words).capitalize() + ("." if rng.random() < 0.9 else "")


def _prose(rng) -> str:
    text = " ".join(_sentence(rng) for _ in range(int(rng.integers(1, 7)))) if rng.random() < 0.75 else _sentence(rng, 1, 4)
    kind = rng.random()
    if kind < 0.06:  # rows of a plain table
        return text.replace(" ", " | ")
    if kind < 0.10:
        return text.upper().replace(" ", "!! ")
    if kind < 0.14:  # words with marks, numbers or repeats
        return " ".join(w + str(rng.choice(["***", "&amp;&amp;", "%", "###", " 42", "", ";"])) for w in text.split())
    if kind < 0.17:
        return " ".join([text.split()[0]] * int(rng.integers(2, 30)))
    return text


def make_page(rng) -> tuple[str, list[str]]:
    """A page, and the texts of its main blocks in page order."""
    main: list[str] = []

    def attr(mark: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{mark}"' if mark else ""

    def boiler(kind: str) -> str:
        tag, mark = _OTHER[kind][rng.integers(len(_OTHER[kind]))]
        n = int(rng.integers(1, 7))
        pool = _BOILER[kind]
        texts = [str(pool[rng.integers(len(pool))]) if rng.random() < 0.35 else _sentence(rng, 1, 9) if rng.random() < 0.6 else _prose(rng) for _ in range(n)]
        if kind in ("menu", "side") and rng.random() < 0.7 or tag in ("ul", "ol"):
            items = "".join(f"<li>{f'<a href=/{_word(rng)}>{t}</a>' if kind != 'comment' else t}</li>" for t in texts)
            return f"<{tag}{attr(mark)}>{items if tag in ('ul', 'ol') else f'<ul>{items}</ul>'}</{tag}>"
        if kind == "form":
            return f"<{tag}{attr(mark)}>" + "".join(f"<label>{t}</label><input name=x><br>" for t in texts) + f"<button>{texts[0]}</button></{tag}>"
        if rng.random() < 0.4:
            return f"<{tag}{attr(mark)}>{' &middot; '.join(texts)}</{tag}>"
        inner = rng.choice(["p", "div", "span><br", "h3", "p"])
        return f"<{tag}{attr(mark)}>" + "".join(f"<{inner}>{t}</{inner.split('>')[0]}>" for t in texts) + f"</{tag}>"

    def add(text: str) -> str:
        main.append(text)
        return text

    def body_block() -> str:
        r = rng.random()
        if r < 0.62:
            return f"<p>{add(_prose(rng))}</p>"
        if r < 0.72:
            return f"<p><b>{add(_sentence(rng))}<br>" if rng.random() < 0.7 else f"<b>{add(_sentence(rng))}</b><br>"
        if r < 0.80:
            h = rng.choice(["h2", "h3", "h4"])
            return f"<{h}>{add(_sentence(rng, 1, 7))}</{h}>"
        if r < 0.86:
            return "<ul>" + "".join(f"<li>{add(_sentence(rng))}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        if r < 0.90:
            return f"<blockquote><p>{add(_prose(rng))}</p></blockquote>"
        if r < 0.94:
            return f"<pre>{add(_sentence(rng))}</pre>"
        if r < 0.97:
            return "<table>" + "".join(f"<tr><td>{add(_word(rng))}</td><td>{add(_sentence(rng, 1, 5))}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>"
        return f'<p>{add(_sentence(rng) + " " + _word(rng))}</p>'

    tag, mark = _MAIN[0] if rng.random() < 0.35 else _MAIN[rng.integers(len(_MAIN))]
    before = [boiler(str(k)) for k in rng.choice(["menu", "menu", "notice", "ad", "side", "form"], int(rng.integers(0, 5)))]
    out = [f"<html><head><title>{_sentence(rng)}</title><style>p{{margin:0}}</style></head><body>", *before]
    if rng.random() < 0.25:
        out.append(f"<div{attr(str(rng.choice(['wrapper', 'page', 'container', 'row'])))}>")
    out.append(f"<{tag}{attr(mark)}>")
    if rng.random() < 0.8:
        out.append(f"<h1>{add(_sentence(rng, 1, 12))}</h1>")
    if rng.random() < 0.2:
        out.append(f"<header><h2>{add(_sentence(rng, 1, 9))}</h2></header>" if rng.random() < 0.3 else "")
    for _ in range(int(rng.integers(1, 14) if rng.random() < 0.92 else rng.integers(14, 60))):
        out.append(body_block())
        if rng.random() < 0.15:
            out.append(boiler(str(rng.choice(["ad", "ad", "side", "side", "notice", "form", "comment"]))))
    if rng.random() < 0.25:
        out.append(boiler("comment"))
    out.append(f"</{tag}>")
    out += [boiler(str(k)) for k in rng.choice(["comment", "side", "ad", "foot", "form", "menu", "foot", "notice"], int(rng.integers(0, 5)))]
    if rng.random() < 0.8:
        out.append(boiler("foot"))
    return "".join(out) + "</body></html>", main


def training_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of made pages; a block is main if its text is the
    next of the page's main texts."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        page, main = make_page(rng)
        found, at, y = blocks(page), 0, []
        for b in found:
            hit = at < len(main) and b.text == " ".join(html.unescape(main[at]).split())
            at += hit
            y.append(float(hit))
        if found and at == len(main):
            out.append((vectors(found), np.array(y, np.float32)))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained with Adam; the same on every machine up to
    rounding, and kept for the life of the process."""
    rng = np.random.default_rng(seed)
    data, model = training_pages(pages, seed), Labeller(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        # pages of like length go together, so that little is padding
        chunks = [order[i : i + BATCH * 8] for i in range(0, len(order), BATCH * 8)]
        for chunk in chunks:
            chunk = sorted(chunk.tolist(), key=lambda i: len(data[i][1]))
            for i in range(0, len(chunk), BATCH):
                part = [data[j] for j in chunk[i : i + BATCH]]
                x, mask = _padded([p[0] for p in part])
                drop = (rng.random((1, x.shape[1], DIM)) > 0.05).astype(np.float32)
                drop[..., PATH_DIM : PATH_DIM + WORD_DIM] *= rng.random((1, x.shape[1], 1)) > 0.4  # pages in unknown words
                y = np.zeros_like(mask)
                for k, p in enumerate(part):
                    y[: len(p[1]), k] = p[1]
                g = model.gradients(x * drop, mask, y)
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                rate = 0.012 * (1 - 0.95 * epoch / epochs)
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
