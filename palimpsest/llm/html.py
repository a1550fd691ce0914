"""Main-text extraction by a recurrent block labeller.

A page is cut into blocks, the leaf texts between block-level tags, each with the path of tags (and their
classes and ids) that it stands in. A bidirectional LSTM in numpy reads a page's whole sequence of blocks;
each block is a vector of hashed tag-path and word embeddings and a few shape figures; and every block is
labelled main text or not with what stands before and after it in the page. Blocks labelled main are joined.

The network is trained here, once in the driver, on pages that a seeded grammar makes up (articles among
menus, headers, sidebars, notices, adverts, forms, comments and footers, in many tag and class spellings); it
never sees the pages it labels. Its weights, a few ten thousand numbers whatever the input, go to the tasks.

Defined results. A null or empty page has an empty text. Scripts, styles, comments and markup are never text.
Unclosed tags end with their surroundings. White space inside a block is one space. Repeated rows give
repeated results; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+|©")

#: Elements of HTML by how they shape the text.
RAW = frozenset("script style noscript template textarea select option svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag closes an open element of these names first.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)} | {
    x: ("p",) for x in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}

PATHS, WORDS, DIM, HIDDEN, SHAPES = 2048, 2048, 12, 16, 8


def _hash(x: str) -> int:
    h = 2166136261
    for b in x.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % PATHS


_hash = functools.lru_cache(maxsize=100_000)(_hash)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[int], linked: float):
        self.text, self.path, self.linked = text, path, linked


@functools.lru_cache(maxsize=50_000)
def _labels(name: str, attributes: str) -> tuple[int, ...]:
    """Hashes of a tag's name and of the words of its class, id and role."""
    out = [_hash(name)]
    for _, a, b, c in _NAMED.findall(attributes):
        out += [_hash("." + p) for p in _PART.findall((a or b or c).lower())]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf texts of a page in order, with their tag paths."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                path = [h for name, labels in stack if name in BLOCK for h in labels]
                leaf = stack[-1][0] if stack else ""
                out.append(Block(text, [*path, _hash("leaf " + leaf)], min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece)

    for m in _TOKEN.finditer(page):
        name = (m[2] or "").lower()
        if m.start() < at:
            continue
        text_to(m.start())
        at = m.end()
        if not name:
            continue
        if name in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
        if name in BLOCK:
            flush()
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in VOID:
                for other in CLOSES.get(name, ()):
                    if stack and stack[-1][0] == other:
                        stack.pop()
                stack.append((name, _labels(name, m[3])))
    text_to(len(page))
    flush()
    return out


def _words(text: str) -> list[int]:
    """Hashes of all of a block's words, in lower case and without punctuation."""
    return [_hash(w) % WORDS for w in _WORD.findall(text.lower())] or [0]


def vectors(found: list[Block], params: dict[str, np.ndarray], first: int = 0, total: int | None = None) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """A row for each block, and the path and word hashes that each was made of; they stand from ``first`` on in a page of ``total``."""
    n, tokens = max(1, total or len(found)), [b.text.split() for b in found]
    paths, words = [b.path for b in found], [_words(b.text) for b in found]
    shape = [
        (np.log1p(len(t)) / 4, b.linked, (b.text.count(".") + b.text.count(",")) / (len(t) + 1), i / n, i == 0, b.text[-1] in ".!?…", len(b.path) / 10, min(n, 100) / 100)
        for i, (b, t) in enumerate(zip(found, tokens), first)
    ]
    return np.concatenate([_summed(params["path"], paths), _summed(params["word"], words) / np.array([[len(w)] for w in words]), np.array(shape, float)], axis=1), paths, words


def _summed(table: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Sums of table rows, for lists of at least one row."""
    sizes = np.array([len(r) for r in rows])
    return np.add.reduceat(table[np.concatenate(rows).astype(np.int64)], np.cumsum(sizes) - sizes, axis=0)


#: Words that the furniture of pages is often made of.
SIGNALS = frozenset(
    "cookie cookies subscribe newsletter comment comments reply share copyright privacy policy terms login sign menu home advertisement sponsored related search contact rights reserved © abonnieren kommentar kommentare datenschutz impressum anmelden werbung commentaire commentaires abonnez confidentialité publicité comentario comentarios suscríbete privacidad publicidad".split()
)


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = 2 * DIM + SHAPES
    draw = lambda *s, scale: rng.normal(0, scale, s)
    out = {"path": draw(PATHS, DIM, scale=0.02), "word": np.zeros((WORDS, DIM)), "out": draw(2 * HIDDEN + size, scale=0.1), "bias": np.zeros(1)}
    for way in ("f", "b"):
        out[f"w{way}"] = draw(size + HIDDEN, 4 * HIDDEN, scale=0.2)
        out[f"c{way}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction of the LSTM over (pages, blocks, size); masked steps leave the state as it is."""
    pages, steps, _ = x.shape
    h, s = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out, tape = np.zeros((pages, steps, HIDDEN)), []
    for t in range(steps):
        m = mask[:, t, None]
        z = np.concatenate([x[:, t], h], axis=1)
        a = z @ w + c
        f, i, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        new = f * s + i * g
        th = np.tanh(new)
        if keep:
            tape.append((z, f, i, o, g, s, th, m))
        h, s = np.where(m, o * th, h), np.where(m, new, s)
        out[:, t] = h
    return out, tape


def _back(dh_all: np.ndarray, tape: list, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction: of its input, weights and biases."""
    pages = dh_all.shape[0]
    dh, ds = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    dw, dc, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros((*dh_all.shape[:2], size))
    for t in range(len(tape) - 1, -1, -1):
        z, f, i, o, g, s, th, m = tape[t]
        dh = dh + dh_all[:, t]
        own, pass_h = np.where(m, dh, 0), np.where(m, 0, dh)
        step = np.where(m, ds, 0) + own * o * (1 - th * th)
        da = np.concatenate([step * s * f * (1 - f), step * g * i * (1 - i), own * th * o * (1 - o), step * i * (1 - g * g)], axis=1)
        dw += z.T @ da
        dc += da.sum(axis=0)
        dz = da @ w.T
        dx[:, t] = dz[:, :size]
        dh, ds = dz[:, size:] + pass_h, np.where(m, step * f, ds)
    return dx, dw, dc


def forward(x: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """Chances (pages, blocks) that a block is main text."""
    ahead, tape_f = _pass(x, mask, p["wf"], p["cf"], keep)
    behind, tape_b = _pass(x[:, ::-1], mask[:, ::-1], p["wb"], p["cb"], keep)
    joint = np.concatenate([ahead, behind[:, ::-1], x], axis=2)
    return _sigmoid(joint @ p["out"] + p["bias"]), joint, tape_f, tape_b


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, rows))
    x, mask = np.zeros((len(rows), most, rows[0].shape[1])), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


#: Adam gives each word vector steps of one size, how rare or weak its word may be: shorter ones keep chance words small.
PACE = {"word": 0.3}


def train(pages: list[tuple[list[Block], list[bool]]], seed: int = 7, rounds: int = 7, batch: int = 16, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam over the pages' labelled blocks."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    size, step = 2 * DIM + SHAPES, 0
    for done in range(rounds):
        order = rng.permutation(len(pages))
        rate_now = rate * (1 - done / rounds) + rate / 20
        for at in range(0, len(order), batch):
            group = [pages[i] for i in order[at : at + batch] if pages[i][0]]
            made = [vectors(found, p) for found, _ in group]
            x, mask = pad([r for r, _, _ in made])
            y = np.zeros(mask.shape)
            for i, (_, wanted) in enumerate(group):
                y[i, : len(wanted)] = wanted
            chance, joint, tape_f, tape_b = forward(x, mask, p, keep=True)
            d = np.where(mask, chance - y, 0) / mask.sum()
            grads = {"out": np.tensordot(d, joint, axes=([0, 1], [0, 1])), "bias": d.sum(keepdims=True).ravel()}
            dj = d[..., None] * p["out"]
            dxf, grads["wf"], grads["cf"] = _back(dj[..., :HIDDEN], tape_f, p["wf"], size)
            dxb, grads["wb"], grads["cb"] = _back(dj[:, ::-1, HIDDEN : 2 * HIDDEN], tape_b, p["wb"], size)
            dx = dj[..., 2 * HIDDEN :] + dxf + dxb[:, ::-1]
            grads["path"], grads["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
            for i, (_, paths, words) in enumerate(made):
                for j, (path, word) in enumerate(zip(paths, words)):
                    np.add.at(grads["path"], path, dx[i, j, :DIM])
                    np.add.at(grads["word"], word, dx[i, j, DIM : 2 * DIM] / len(word))
            step += 1
            for k, g in grads.items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p[k] -= rate_now * PACE.get(k, 1) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return p


#: How pages spell the parts that the grammar makes up.
_MAIN = ["article", "main", 'div class="post-content"', 'div class="entry-content"', 'div id="content"', 'div class="article-body"', 'section class="story"', 'div class="text body"', 'div role="main"', "main><article", 'div class="post"><div class="content"']
_NOISE = {
    "menu": ["nav", 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', "menu", 'div class="toc"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'header class="site-header"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"'],
    "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'section class="recommended"', 'div class="related-posts"', 'div class="author-bio"', 'div class="tags"', 'div class="share social"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad"', 'aside class="sponsored"', 'div class="promo banner"', 'div class="ad-slot"', 'section class="ad"', 'p class="ad"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="alert"', 'div class="popup modal"', 'div role="alert"', 'div class="cookie"', 'div class="paywall"', "dialog"],
    "form": ["form", 'form class="newsletter"', 'div class="subscribe"', 'form id="search"', 'div class="newsletter signup"', 'form class="login"'],
    "comments": ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ul class="comments"', 'div id="disqus" class="comments"', 'section class="comments-area"', 'ol class="comment-thread"', 'div class="responses"', 'div class="discussion replies"'],
}


def _close(opening: str) -> str:
    return "".join(f"</{x.strip('<').split()[0].split('>')[0]}>" for x in reversed(opening.split("><")))


def made_up(rng: random.Random) -> str:
    """A page whose main text has @ before each block and whose other blocks don't."""
    word = lambda: "".join(rng.choice("an er th in re on ti es ou le st en ai br ck ö é".split()) for _ in range(rng.randint(1, 4)))
    sentence = lambda low, high: (" ".join(word() for _ in range(rng.randint(low, high))) + rng.choice([".", ".", "!", "?", ""])).capitalize()
    prose = lambda: " ".join(sentence(1, 18) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def signal(p: float) -> str:
        return rng.choice(sorted(SIGNALS)) + " " if rng.random() < p else ""

    def told() -> str:
        """A longer text that only its words tell from prose."""
        words = [signal(0.3) + word() for _ in range(rng.randint(12, 40))]
        return (signal(1) + " ".join(words) + ". " + signal(1) + word() + ".").capitalize()

    def noise(kind: str) -> str:
        tag = rng.choice(_NOISE[kind])
        if kind in ("ad", "notice", "side", "footer") and rng.random() < 0.25:
            tag = rng.choice(["div", "p", "section", "section><p", "div><p"])
            return f"<{tag}>{told()}{_close(tag)}"
        if kind == "menu" or kind == "side" and rng.random() < 0.4:
            item = rng.choice(["li", "div", "p"])
            inner = "".join(f'<{item}><a href="/x">{word()}</a></{item}>' for _ in range(rng.randint(2, 7)))
            inner = f"<ul>{inner}</ul>" if item == "li" and not tag.startswith("ul") else inner
        elif kind == "comments":
            heading = f"<h3>{signal(0.5)}{sentence(1, 3)}</h3>" if rng.random() < 0.6 else ""
            item = rng.choice(['div class="comment"', "li", "article", 'div class="comment-body"', "p", 'article class="comment"'])
            inner = heading + "".join(f"<{item}>" + rng.choice(["<p>{}</p>", "{}", "<b>x</b><p>{}</p>"]).format(prose()) + f"</{item.split()[0]}>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{signal(0.6)}{sentence(1, 4)}</label><input type=text><button>{sentence(1, 2)}</button>" + (f"<p>{prose()}</p>" if rng.random() < 0.4 else "")
        else:
            body = signal(0.4) + (prose() if rng.random() < 0.6 else sentence(1, 10))
            inner = rng.choice(["{}", "<p>{}</p>", "<h4>{}</h4>", "<span>{}</span>", '<a href="#">{}</a>', "<p>{}</p><p>{}</p>"]).replace("{}", body)
        return f"<{tag}>{inner}{_close(tag)}"

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.72:
            return rng.choice(["<p>@{}</p>", "<p>@{}</p>", "<p>@{}", "<p><b>@{}</b></p>", "<p><b>@{}<br>", '<p>@{} <a href="/y">x</a></p>']).format(prose())
        if kind < 0.8:
            return rng.choice(["<h2>@{}</h2>", "<h3>@{}</h3>"]).format(sentence(1, 7))
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>@{sentence(1, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return rng.choice(["<blockquote>@{}</blockquote>", "<blockquote><p>@{}</p></blockquote>", "<pre>@{}</pre>", "<div>@{}</div>", "<section><p>@{}</p></section>"]).format(prose())
        return noise(rng.choice(["ad", "ad", "side", "notice", "form"])) if rng.random() < 0.6 else f"<p>@{sentence(1, 12)}</p>"

    main = rng.choice(_MAIN) if rng.random() < 0.6 else "article"
    title = sentence(2, 10)
    inner = (rng.choice(["<h1>@{}</h1>", "<h1>@{}</h1>", '<h1 class="title">@{}</h1>', "<h2>@{}</h2>"]).format(title) if rng.random() < 0.9 else "") + "".join(body_part() for _ in range(rng.randint(1, 14)))
    if rng.random() < 0.15:
        inner += noise("comments")
    before = "".join(noise(k) for k in ("notice", "header", "menu", "ad", "form", "side") if rng.random() < 0.5)
    after = "".join(noise(k) for k in ("side", "ad", "form", "comments", "menu", "notice", "footer") if rng.random() < 0.5)
    head = f"<head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head>" if rng.random() < 0.9 else ""
    wrap = rng.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
    return f"<!DOCTYPE html><html>{head}<body>" + wrap.format(f"{before}<{main}>{inner}{_close(main)}{after}") + rng.choice(["</body></html>", ""])


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """A made-up page's blocks, without their marks, and which are main text."""
    found = blocks(page)
    wanted = [b.text.startswith("@") for b in found]
    kept = []
    for b, w in zip(found, wanted):
        b.text = b.text[1:].strip() if w else b.text
        kept.append(bool(b.text))
    return [b for b, k in zip(found, kept) if k], [w for w, k in zip(wanted, kept) if k]


@functools.lru_cache(maxsize=2)
def trained(pages: int = 800, seed: int = 7) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    return train([labelled(made_up(rng)) for _ in range(pages)], seed)


def label(pages: list[list[Block]], params: dict[str, np.ndarray], cells: int = 8192, overlap: int = 512) -> list[np.ndarray]:
    """For each page, which of its blocks are main text.

    Pages of like length are padded together up to so many cells. A page of more blocks than that is read in windows, each with
    ``overlap`` blocks of context on both sides, so that memory stays bounded whatever a page holds.
    """
    windows: list[tuple[int, int, int, int, int]] = []  # page, from, to, and what of it counts
    for i, page in enumerate(pages):
        step = len(page) if len(page) <= cells else cells - 2 * overlap
        for at in range(0, len(page), step or 1):
            windows.append((i, max(0, at - overlap) if at else 0, min(len(page), at + step + overlap), at, min(len(page), at + step)))
    out = [np.zeros(len(p), bool) for p in pages]
    windows.sort(key=lambda w: w[2] - w[1])
    at = 0
    while at < len(windows):
        end = at + 1
        while end < len(windows) and end - at < 64 and (end - at + 1) * (windows[end][2] - windows[end][1]) <= cells:
            end += 1
        own = windows[at:end]
        x, mask = pad([vectors(pages[i][a:b], params, a, len(pages[i]))[0] for i, a, b, _, _ in own])
        chance = forward(x, mask, params)[0]
        for (i, a, _, first, last), c in zip(own, chance):
            out[i][first:last] = c[first - a : last - a] >= 0.5
        at = end
    return out


def extract(pages: DataFrame, params: dict[str, np.ndarray] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = {k: v.astype(np.float32) for k, v in (params or trained()).items()}
    schema = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, main in zip(page, keep) if main) for page, keep in zip(found, label(found, weights))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.fieldNames())

    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, schema)
