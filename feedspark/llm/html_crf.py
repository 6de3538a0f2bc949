"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is article or not. Its features are the tags and the words of class, id and role of its ancestors, and its
text: number of words, share of link text, end punctuation, signs that boilerplate uses. Neighbouring labels share
a transition weight, decoding is by Viterbi. The model is trained by gradient on labelled pages: ``labelled_pages``
lays out pages of known parts in many ways of marking them up; other labelled pages can be given instead.

Training runs on the driver over a bounded number of pages (``TRAIN_PAGES``); the weights, a few hundred
numbers, go to the tasks, which extract every page of the table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, leaf_blocks

TRAIN_PAGES, EPOCHS, RATE, L2 = 600, 120, 0.5, 3e-4


# --- features ---

SECTIONS = frozenset("article aside dialog footer form header main nav section".split())


def path_features(path: tuple) -> list[str]:
    out = {"leaf:" + path[-1][0]} if path else {"leaf:"}
    for depth, (tag, words) in enumerate(path):
        if tag not in ("html", "body", "div", "p"):
            out.add("in:" + tag)
        out.update("word:" + w for w in words)
        if tag in ("header", "footer") and any(t == "article" for t, _ in path[:depth]):
            out.add(f"inner:{tag}:{path[-1][0][:1]}")
    marked = [x for x in path if x[1] or x[0] in SECTIONS]
    if marked:  # the innermost element that says what it is
        tag, words = marked[-1]
        out.add("near:" + tag)
        out.update("nearword:" + w for w in words)
    return sorted(out)


def text_features(block: Block) -> list[str]:
    n, share = block.text.count(" ") + 1, block.link_chars / max(len(block.text), 1)
    out = ["words:" + ("1" if n < 2 else "4" if n < 5 else "9" if n < 10 else "24" if n < 25 else "more"),
           "links:" + ("0" if not share else "some" if share < 0.5 else "most")]
    if block.text[-1] in ".!?…\"”":
        out.append("stop")
    if "©" in block.text:
        out.append("sign")
    return out


# --- labelled pages ---

_SYLLABLES = "an the er ti on re st in al ou ment tion de la ver ung ch ein os que".split()

#: Ways to mark up the parts of a page: (opening, closing) of what is around them.
MAIN = [("<article>", "</article>"), ('<article class="post">', "</article>"), ('<main><article>', "</article></main>"),
        ('<div id="content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="article-body">', "</section>"),
        ('<main>', "</main>"), ('<div role="main"><div class="story">', "</div></div>"), ('<div class="post-text">', "</div>"),
        ('<table><tr><td class="main content">', "</td></tr></table>"), ('<div class="page"><div class="body">', "</div></div>")]
MENUS = [("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navbar">', "</div>"), ('<header><nav class="main-nav">', "</nav></header>"),
         ('<div class="breadcrumb">', "</div>"), ('<ul class="pagination">', "</ul>"), ('<div role="navigation">', "</div>"), ('<ul class="tags">', "</ul>")]
HEADERS = [("<header>", "</header>"), ('<div id="header">', "</div>"), ('<div class="masthead">', "</div>"), ('<div class="topbar">', "</div>"),
           ('<div role="banner">', "</div>"), ('<header class="site-header">', "</header>")]
FOOTERS = [("<footer>", "</footer>"), ('<div id="footer">', "</div>"), ('<div class="site-footer">', "</div>"), ('<div role="contentinfo">', "</div>"),
           ('<div class="copyright">', "</div>")]
ASIDES = [("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar" class="widget">', "</div>"), ('<div class="related">', "</div>"),
          ('<section class="recommended">', "</section>"), ('<div role="complementary">', "</div>"), ('<div class="author bio">', "</div>"),
          ('<div class="share social">', "</div>")]
NOTICES = [('<div class="notice">', "</div>"), ('<div id="cookie-consent">', "</div>"), ('<div class="alert banner">', "</div>"),
           ('<div class="popup modal">', "</div>"), ('<div class="newsletter subscribe">', "</div>"), ('<div role="alert">', "</div>"),
           ('<dialog>', "</dialog>"), ('<div class="disclaimer">', "</div>")]
ADVERTS = [('<div class="ad">', "</div>"), ('<div class="ads">', "</div>"), ('<div id="advert">', "</div>"), ('<div class="advertisement">', "</div>"),
           ('<div class="sponsored">', "</div>"), ('<section class="promo">', "</section>"), ('<aside class="ad-slot sponsor">', "</aside>")]
FORMS = [("<form>", "</form>"), ('<form class="search">', "</form>"), ('<form id="login">', "</form>"), ('<div class="signup form"><form>', "</form></div>")]
COMMENTS = [('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<div id="disqus" class="comment-list">', "</div>"),
            ('<ol class="commentlist">', "</ol>"), ('<section class="responses discussion">', "</section>"), ('<div class="replies reviews">', "</div>")]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 1) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of ``n`` pages laid out from known parts; the same for the same ``seed``."""
    draw = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(lo, hi)))

    def sentence(lo: int = 1, hi: int = 40) -> str:
        return words(lo, hi).capitalize() + draw.choice([".", ".", ".", "!", "", "&amp;"])

    def links(k: int) -> str:
        tag = draw.choice(["li", "li", "span", "div"])
        row = "".join(f'<{tag}><a href="/x">{words(1, 4)}</a></{tag}>' for _ in range(k))
        return f"<ul>{row}</ul>" if tag == "li" else row

    def around(part: list, inside: str) -> str:
        opening, closing = draw.choice(part)
        return opening + inside + closing

    def rest(kind: int) -> str:
        if kind == 0:
            return around(MENUS, links(draw.randint(1, 8)))
        if kind == 1:
            return around(HEADERS, f"<h{draw.randint(1, 2)}>{words(1, 5)}</h1>" + (links(4) if draw.random() < 0.5 else sentence()))
        if kind == 2:
            return around(FOOTERS, draw.choice(["&copy; ", ""]) + sentence(1, 15) + (links(3) if draw.random() < 0.5 else ""))
        if kind == 3:
            return around(ASIDES, f"<h3>{words(1, 4)}</h3>" + draw.choice([links(4), f"<p>{sentence()}</p>"]))
        if kind == 4:
            return around(NOTICES, draw.choice([sentence(), f"<p>{sentence()}</p><button>{words(1, 2)}</button>"]))
        if kind == 5:
            return around(ADVERTS, draw.choice([sentence(), f"<p>{sentence()}</p>", f"<a href='/b'>{sentence()}</a>"]))
        if kind == 6:
            return around(FORMS, f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" + (sentence() if draw.random() < 0.3 else ""))
        inner = "".join(draw.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<article class='comment'><p>{}</p></article>",
                                     '<div class="comment-content text">{}</div>', "<p>{}</p>"]).format(sentence())
                        for _ in range(draw.randint(1, 4)))
        return around(COMMENTS, f"<h3>{words(1, 3)}</h3>" + inner)

    def main_block() -> str:
        kind = draw.random()
        if draw.random() < 0.1:  # tables of words and other odd text are article text, too
            return f"<p>{draw.choice([' | ', '; ', '### ', ' © '])[:-1].join(words(1, 2) for _ in range(draw.randint(1, 12)))}</p>"
        text = sentence(1, 8) if draw.random() < 0.35 else " ".join(sentence(3, 30) for _ in range(draw.randint(1, 4)))
        if draw.random() < 0.25:
            text += f' <a href="/y">{words(1, 5)}</a> {words(1, 4)}'
        for limit, form in ((0.62, "<p>{}</p>"), (0.7, "<p><b>{}<br>"), (0.76, "<h2>{}</h2>"), (0.8, "<blockquote>{}</blockquote>"),
                            (0.84, "<ul><li>{}</li></ul>"), (0.88, "<pre>{}</pre>"), (0.92, "<table><tr><td>{}</td></tr></table>"),
                            (0.95, "<figure><figcaption>{}</figcaption></figure>"), (1.0, "<div>{}</div>")):
            if kind < limit:
                break
        return form.format(text)

    pages = []
    for _ in range(n):
        pieces: list[tuple[str, bool]] = [(rest(draw.choice([0, 0, 1, 4, 5, 6, 3])), False) for _ in range(draw.randint(0, 4))]
        opening, closing = draw.choice(MAIN)
        title = f"<h1>{words(1, 9)}</h1>"
        inside = [(opening, True), (f"<header>{title}</header>" if draw.random() < 0.1 else title if draw.random() < 0.9 else "", True)]
        for _ in range(draw.randint(1, 14)):
            inside.append((main_block(), True))
            if draw.random() < 0.12:
                inside.append((rest(draw.choice([3, 4, 5, 5, 6])), False))
        if draw.random() < 0.15:
            inside.append((f"<footer>{links(2)}</footer>", False))
        if draw.random() < 0.15:
            inside.append((rest(7), False))
        pieces += [*inside, (closing, True)]
        pieces += [(rest(draw.choice([7, 7, 3, 5, 6, 4, 0])), False) for _ in range(draw.randint(0, 3))]
        if draw.random() < 0.9:
            pieces.append((rest(2), False))
        # blocks of the page so far, piece by piece: the number of blocks before a piece ends tells its label
        html, labels = "", []
        for piece, label in pieces:
            html += piece
            labels += [label] * (len(leaf_blocks(html)) - len(labels))
        pages.append((leaf_blocks(html), labels))
    return pages


# --- the model ---

class Model:
    """Weights of features for 'article' against 'not', and of the label before: (start, transitions, end)."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, change: np.ndarray):
        self.weights, self.start, self.change = weights, start, change
        self.paths: dict[tuple, float] = {}

    def emission(self, block: Block) -> float:
        if block.path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return self.paths[block.path] + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Most likely labels by Viterbi; ties go to 'not'."""
        if not blocks:
            return []
        (a, b), ((c00, c01), (c10, c11)) = self.start.tolist(), self.change.tolist()
        back = []
        no, yes = a, b + self.emission(blocks[0])
        for block in blocks[1:]:
            e = self.emission(block)
            from_no, from_yes = no + c01, yes + c11
            back.append((yes + c10 > no + c00, from_yes > from_no))
            no, yes = max(no + c00, yes + c10), max(from_no, from_yes) + e
        label = yes > no
        out = [label]
        for to_no, to_yes in reversed(back):
            label = to_yes if label else to_no
            out.append(label)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        return " ".join(b.text for b, use in zip(blocks, self.decode(blocks), strict=True) if use)


def train(pages: list[tuple[list[Block], list[bool]]], epochs: int = EPOCHS) -> Model:
    """Conditional likelihood by gradient steps (AdaGrad) over all pages at once, forward and backward in log space."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    page, place, feature = [], [], []
    for k, (blocks, _) in enumerate(pages):
        for t, block in enumerate(blocks):
            for f in path_features(block.path) + text_features(block):
                page.append(k)
                place.append(t)
                feature.append(names.setdefault(f, len(names)))
    page, place, feature = map(np.array, (page, place, feature))
    sizes = np.array([len(b) for b, _ in pages])
    n, t_max = len(pages), int(sizes.max())
    inside = np.arange(t_max) < sizes[:, None]
    gold = np.zeros((n, t_max), int)
    for k, (_, labels) in enumerate(pages):
        gold[k, :len(labels)] = labels
    pairs = inside[:, 1:]
    seen_change = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_start = np.bincount(gold[:, 0], minlength=2).astype(float)
    w, start, change = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    squares = [np.full(x.shape, 1e-3) for x in (w, start, change)]
    for _ in range(epochs):
        emit = np.zeros((n, t_max, 2))
        np.add.at(emit[:, :, 1], (page, place), w[feature])
        ahead, behind = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, t_max):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + change, axis=1) + emit[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            step = np.logaddexp.reduce(change + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(inside[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - total[:, None, None])
        joint = np.exp(ahead[:, :-1, :, None] + change + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        gradient = [np.bincount(feature, (gold - p[:, :, 1])[page, place], len(names)) - L2 * n * w,
                    seen_start - p[:, 0].sum(0), seen_change - joint.sum((0, 1))]
        for x, g, s in zip((w, start, change), gradient, squares, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Model({f: float(w[k]) for f, k in names.items()}, start, change)


def _extractor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            texts = [crf.extract(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html).

    NULL or empty html and pages without an article give an empty text; repeated rows and NULL ids come back as they
    are; an empty table gives no rows. Without ``model`` one is trained on ``labelled_pages()``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extractor(shared), "page_id long, url string, text string, n_chars long")
