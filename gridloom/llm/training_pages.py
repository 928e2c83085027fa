"""Labelled web pages to train the extraction on, drawn from a page grammar with a fixed seed.

No given table has labelled pages. The grammar lays out pages the usual ways: the article in an `article`, `main` or
classed container or bare in the body; menus, headers, footers, sidebars, notices, adverts, forms and comments before,
inside and after it, each as its own element or a classed container, with short and long texts alike. A block of the
article begins with LABEL_MARK.
"""

from __future__ import annotations

import numpy as np

LABEL_MARK = "¶"
PAGES = 700
SEED = 7

#: Containers of each kind of block: element, or class words for a div, section or list.
ARTICLE = ["article", "main", "content", "article", "post", "entry content", "story", "article body", "post body", "page content", "main text", "text", "body copy", "articleBody"]
OTHER = {
    "menu": ["nav", "nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "main menu", "nav links", "tabs", "skip link", "role navigation", "toolbar"],
    "header": ["header", "header", "site header", "masthead", "banner", "topbar", "page header", "logo", "role banner", "hero brand"],
    "footer": ["footer", "footer", "site footer", "page footer", "copyright", "bottom", "legal", "credits", "colophon", "role contentinfo"],
    "sidebar": ["aside", "aside", "sidebar", "side", "widget", "related", "related posts", "recommended", "trending", "popular", "most read", "rail", "role complementary", "see also", "teaser"],
    "notice": ["notice", "cookie", "cookie notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message", "toast", "dialog", "cookies", "disclaimer", "role alert", "role dialog", "notification", "warning"],
    "advert": ["ad", "ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "ad slot", "ad banner", "adsense", "commercial", "outbrain", "taboola"],
    "form": ["form", "form", "login", "signup", "search", "search form", "contact form", "feedback", "register", "survey"],
    "comments": ["comments", "comment", "comment list", "comment body", "respond", "discussion", "replies", "reply", "reader comments", "user comments", "disqus thread", "responses", "reviews"],
    "share": ["share", "social", "sharing", "share buttons", "tags", "byline meta", "author bio", "follow", "print tools", "meta"],
}
ELEMENTS = {"article", "main", "nav", "header", "footer", "aside", "form", "dialog"}


def _page(rng: np.random.Generator) -> str:
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick(["an", "er", "tion", "ou", "st", "le", "re", "in"]) for _ in range(int(rng.integers(1, 4))))

    def sentence(low: int, high: int, stop: float = 0.9) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high)))) + ("." if chance(stop) else "")

    def some() -> str:
        return sentence(*pick([(1, 2), (1, 4), (4, 12), (12, 40), (30, 120)]))

    def marked(text: str) -> str:
        """Inline marks, which tell nothing about where a text belongs."""
        marks = ["{}", "{}", "{}", "<b>{}</b>", "<em>{}</em>", "{} <a href='/x'>" + word() + "</a>", "<b>{}<br>", "<span>{}</span>", "<strong>{}</strong>", "<i>{}</i>"]
        return pick(marks).format(text)

    def piece(text) -> str:
        """A block in one of the usual forms, in articles and outside alike."""
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{marked(text())}" + ("</p>" if chance(0.8) else "")
        if kind < 0.7:
            return f"<h{(n := pick([1, 2, 3, 4]))}>{text()}</h{n}>"
        if kind < 0.8:
            return f"<{(n := pick(['ul', 'ol']))}>{''.join(f'<li>{marked(text())}</li>' for _ in range(int(rng.integers(1, 5))))}</{n}>"
        if kind < 0.84:
            return f"<blockquote>{pick(['{}', '<p>{}</p>']).format(text())}</blockquote>"
        if kind < 0.88:
            return f"<pre>{text()}</pre>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{text()}</figcaption></figure>"
        if kind < 0.96:
            return f"<table>{''.join(f'<tr><td>{text()}</td><td>{marked(text())}</td></tr>' for _ in range(2))}</table>"
        return f"<div>{marked(text())}</div>"

    def box(name: str, inner: str) -> str:
        if name in ELEMENTS:
            return f"<{name}>{inner}</{name}>" if chance(0.6) else f'<{name} class="{word()}">{inner}</{name}>'
        if name.startswith("role "):
            return f'<div role="{name[5:]}">{inner}</div>'
        tag = pick(["div", "div", "div", "section"])
        joined = name.replace(" ", pick(["-", "_", " "]))
        return f'<{tag} {pick(["class", "class", "id"])}="{joined}{pick(["", " " + word(), "-" + word()])}">{inner}</{tag}>'

    def article_block() -> str:
        return piece(lambda: f"{LABEL_MARK} {some()}")

    def other(kind: str) -> str:
        name = pick(OTHER[kind])
        n = int(rng.integers(1, 6))
        if kind == "menu":
            inner = pick(["<ul>{}</ul>", "{}", "<ol>{}</ol>"]).format("".join(f'<li><a href="/{word()}">{sentence(1, 4, 0.2)}</a></li>' for _ in range(n)))
        elif kind == "header":
            inner = f"{pick(['<h1>{}</h1>', '<a href=/>{}</a>', '<p>{}</p>', '{}']).format(sentence(1, 8, 0.4))}" + (f"<p>{some()}</p>" if chance(0.4) else "")
        elif kind == "footer":
            inner = pick(["&copy; {} {}", "<p>&copy; {}</p><p>{}</p>", "<p>{}</p><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "{} &middot; {}"]).format(sentence(1, 5), some())
        elif kind == "form":
            inner = f"<label>{sentence(1, 4, 0.3)}</label><input name=q><p>{some()}</p><button>{word()}</button>"
        elif kind == "comments":
            one = pick(["<p>{}</p>", "<div>{}</div>", "<li><p>{}</p></li>", "<article><p>{}</p></article>", "<b>" + word() + "</b><p>{}</p>"])
            inner = (f"<h3>{sentence(1, 4, 0.2)}</h3>" if chance(0.5) else "") + "".join(one.format(some()) for _ in range(n))
        elif kind == "share":
            inner = "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(n)) if chance(0.6) else f"<p>{some()}</p>"
        else:
            one = pick(["<p>{}</p>", "{}", "<div>{}</div>", "<li>{}</li>", "<a href=/x>{}</a>", "<h3>{}</h3>"])
            inner = "".join(one.format(some()) for _ in range(n if kind == "sidebar" else max(1, n // 2)))
        if kind != "menu" and chance(0.4):
            inner += "".join(piece(some) for _ in range(int(rng.integers(1, 4))))
        return box(name, inner)

    kinds = list(OTHER)
    around = lambda p, names: "".join(other(k) for k in names if chance(p))
    title = f"<h1>{LABEL_MARK} {sentence(1, 14, 0.5)}</h1>" if chance(0.85) else ""
    body = [article_block() for _ in range(int(rng.integers(1, 9)))]
    if chance(0.55):
        for _ in range(int(rng.integers(1, 4))):
            body.insert(int(rng.integers(len(body) + 1)), other(pick(kinds)))
    inner = title + "".join(body)
    form = rng.random()
    if form < 0.88:
        inner = box(pick(ARTICLE), inner)
        if chance(0.3):
            inner = box(pick(["main", "content", "wrapper", "container", "page", "row"]), inner + around(0.3, ["comments", "sidebar", "advert", "share"]))
    elif form < 0.94:
        inner = f'<div class="{word()}">{inner}</div>'
    before = around(0.45, ["header", "menu", "notice", "advert", "sidebar", "form"])
    after = around(0.4, ["share", "comments", "sidebar", "advert", "notice", "menu", "form"]) + around(0.75, ["footer"])
    body = before + inner + after
    if chance(0.3):
        body = f'<div class="{pick(["wrapper", "container", "page", "site", "layout", word()])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{body}" + ("</body></html>" if chance(0.9) else "")


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    rng = np.random.default_rng(seed)
    return [_page(rng) for _ in range(pages)]
