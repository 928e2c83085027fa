"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes a sequence of blocks of text, each with the tags, class and id words and roles of its ancestors and a
few facts about its text. The field labels the sequence; Viterbi picks the best labels, and the article's blocks are
joined. It is trained on labelled pages (`training_pages.labelled_pages`) by gradient ascent on the likelihood,
on the driver, and only its weights travel. Every page is one row's work.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.llm.training_pages import LABEL_MARK, labelled_pages

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>?)""", re.S)
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\s(hidden)(?=[\s=>/])""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without readable text; their content is passed over unparsed.
SKIPPED = frozenset("script style title textarea noscript template iframe svg math select option canvas object audio video".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: An opening tag ends an open one of these, unless a boundary lies between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ROUNDS, RATE, RIDGE = 200, 0.2, 1e-4
LEAST_PAGES = 5


class Block:
    __slots__ = ("text", "above", "linked", "tag")

    def __init__(self, text: str, above: frozenset, linked: float, tag: str):
        self.text, self.above, self.linked, self.tag = text, above, linked, tag


def _marks(tag: str, source: str) -> set[str]:
    out = {f"tag {tag}"}
    for m in ATTRIBUTE.finditer(source):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.add("hidden")
        elif name == "role":
            out.add(f"role {value}")
        elif name != "style":
            out.update(f"word {w}" for w in WORD.findall(value))
    return out


def blocks(page: str | None, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order. `known` limits the ancestors' marks, so deep nesting costs no more than they are."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, str]] = [("", frozenset(), "")]  # tag, marks of it and all above, nearest block tag
    opened: dict[str, int] = {}
    parts: list[str] = []
    first, linked = None, 0

    def flush() -> None:
        nonlocal first, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, first[1], linked / len(text), first[2]))
            parts.clear()
        first, linked = None, 0

    def drop(n: int) -> None:
        for tag, *_ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]

    def add(text: str) -> None:
        nonlocal first, linked
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        seen = text.strip()
        if seen:
            first = first or stack[-1]
            if opened.get("a"):
                linked += len(seen)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at, source = m.end(), m[0]
        if source[1] in "!?":
            continue
        closing = source[1] == "/"
        tag = NAME.match(source, 2 if closing else 1)[0].lower()
        if tag in BLOCK:
            flush()
        if closing:
            if opened.get(tag):
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                drop(n)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in SKIPPED:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else (end if tag in ("script", "style", "title", "textarea") else at)
            continue
        if tag in BLOCK and opened.get("p"):
            n = len(stack) - 1
            while stack[n][0] != "p":
                n -= 1
            drop(n)
        if tag in ENDS:
            names, stops = ENDS[tag]
            n = len(stack) - 1
            while n > 0 and stack[n][0] not in names and stack[n][0] not in stops:
                n -= 1
            if n > 0 and stack[n][0] in names:
                drop(n)
        marks = _marks(tag, source)
        marks = stack[-1][1].union(marks if known is None else marks & known) if (known is None or marks & known) else stack[-1][1]
        stack.append((tag, marks, tag if tag in BLOCK else stack[-1][2]))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(b: Block) -> list[str]:
    n = b.text.count(" ") + 1
    size = 1 if n == 1 else 2 if n < 5 else 3 if n < 10 else 4 if n < 25 else 5
    links = 0 if b.linked == 0 else 1 if b.linked < 0.3 else 2 if b.linked < 0.7 else 3
    out = ["any", f"nearest {b.tag}", f"size {size}", f"links {links}", *b.above]
    if b.text[-1] in ".!?:;…»”\"'":
        out.append("sentence")
    if "©" in b.text[:40]:
        out.append("rights")
    return out


class Field:
    """Weights of the features for the label `article` against `other`, and of the labels' order."""

    def __init__(self, weights: dict[str, float], order: np.ndarray, start: np.ndarray):
        self.weights, self.order, self.start = weights, order.tolist(), start.tolist()
        self.known = frozenset(weights)

    def labels(self, page: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels; other wins a tie."""
        if not page:
            return []
        (oo, oa), (ao, aa) = self.order
        get = self.weights.get
        scores = [sum(get(f, 0.0) for f in features(b)) for b in page]
        other, article = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            back.append((ao + article > oo + other, aa + article > oa + other))
            other, article = max(oo + other, ao + article), max(oa + other, aa + article) + s
        now = article > other
        out = [now]
        for step in reversed(back):
            now = step[now]
            out.append(now)
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page, self.known)
        return " ".join(b.text for b, keep in zip(found, self.labels(found)) if keep)


def fit(pages: list[list[tuple[list[str], bool]]]) -> Field:
    """Gradient ascent (Adam) on the regularised likelihood of labelled block sequences.

    Marks of fewer than LEAST_PAGES pages, such as a site's own class words, say nothing in general and stay out.
    """
    spread = Counter(f for page in pages for f in {f for fs, _ in page for f in fs})
    names = sorted(f for f, n in spread.items() if n >= LEAST_PAGES)
    place = {f: i for i, f in enumerate(names)}
    longest = max(map(len, pages))
    live = np.arange(longest) < np.array([len(page) for page in pages])[:, None]
    x = np.zeros((int(live.sum()), len(names)), np.float32)  # one row per block, page after page
    for row, fs in zip(x, (fs for page in pages for fs, _ in page)):
        row[[place[f] for f in fs if f in place]] = 1
    y = np.zeros(live.shape, np.int64)
    y[live] = [label for page in pages for _, label in page]
    pairs = live[:, 1:]
    seen_x = x.T @ y[live].astype(np.float32)
    seen_order = np.zeros((2, 2))
    np.add.at(seen_order, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    seen_start = np.bincount(y[:, 0], minlength=2)
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        w, order, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        s = np.zeros((2, *live.shape))
        s[1][live] = x @ w.astype(np.float32)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, :, 0] = start[:, None] + s[:, :, 0]
        for t in range(1, longest):
            for k in (0, 1):
                moved = np.logaddexp(forward[0, :, t - 1] + order[0, k], forward[1, :, t - 1] + order[1, k]) + s[k, :, t]
                forward[k, :, t] = np.where(live[:, t], moved, forward[k, :, t - 1])
        for t in range(longest - 2, -1, -1):
            for k in (0, 1):
                moved = np.logaddexp(order[k, 0] + s[0, :, t + 1] + backward[0, :, t + 1], order[k, 1] + s[1, :, t + 1] + backward[1, :, t + 1])
                backward[k, :, t] = np.where(live[:, t + 1], moved, backward[k, :, t + 1])
        z = np.logaddexp(forward[0, :, -1], forward[1, :, -1])[:, None]
        article = np.exp(forward[1] + backward[1] - z)
        two = [[(np.exp(forward[j, :, :-1] + order[j, k] + s[k, :, 1:] + backward[k, :, 1:] - z) * pairs).sum() for k in (0, 1)] for j in (0, 1)]
        first = article[:, 0].sum()
        gradient = np.concatenate([seen_x - x.T @ article[live].astype(np.float32), (seen_order - two).ravel(), seen_start - [len(pages) - first, first]])
        gradient = gradient / len(pages) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(dict(zip(names, theta[:-6].tolist())), theta[-6:-2].reshape(2, 2), theta[-2:])


def sequence(page: str) -> list[tuple[list[str], bool]]:
    """Features and labels of a labelled page, whose article blocks begin with LABEL_MARK."""
    return [(features(b), b.text.startswith(LABEL_MARK)) for b in blocks(page)]


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit([s for s in map(sequence, labelled_pages()) if s])


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of `pages`.

    Null and empty pages, and pages without an article, have an empty text. Broken markup is read as far as it goes:
    unclosed elements end with their parents, a bare `<` is text. Repeated rows give repeated rows, an empty table an
    empty one; further columns are ignored.
    """
    field = field or trained()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [field.text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
