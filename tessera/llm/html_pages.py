"""Labelled training pages: page layouts with each text block marked as article or not.

The pages are drawn from layouts with a fixed seed; words are drawn from
syllables, so no text feature gives a label away by vocabulary. The number of
pages is a parameter of the trainer.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go hu in ja ka lo mi no or pe qu ri sa te un va wo xy ze é ü ñ th st".split()
#: Class or id names that page authors give to the parts of a page.
ARTICLE_NAMES = "content main-content post post-body entry entry-content article article-body story story-body body-text page-content text blog-post"
MENU_NAMES = "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs tabs pagination pager toc"
HEADER_NAMES = "header site-header masthead topbar top-bar page-header branding logo"
FOOTER_NAMES = "footer site-footer page-footer bottom copyright legal colophon"
SIDE_NAMES = "sidebar side-bar side aside widget widgets rail right-column related related-posts recommended popular trending tags share sharing social author-box"
AD_NAMES = "ad ads advert advertisement advertising banner sponsor sponsored promo promotion adsbox ad-slot"
NOTICE_NAMES = "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal overlay newsletter subscribe subscription disclaimer paywall signup"
FORM_NAMES = "form search search-form login contact-form newsletter-form"
COMMENT_NAMES = "comments comment comment-list commentlist comment-body reply replies respond discussion disqus responses"


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _sentence(r: random.Random, low: int = 3, high: int = 60) -> str:
    return _words(r, low, high).capitalize() + r.choice(["."] * 8 + ["!", "?", ""])


def _mark(r: random.Random, names: str, chance: float = 0.9) -> str:
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}{r.choice(["", "", f" c{r.randint(1, 9)}"])}"' if r.random() < chance else ""


def _links(r: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">[[0]]{_words(r, 1, 3)}</a></li>' for k in range(r.randint(2, 7))) + "</ul>"


def _blocks(r: random.Random, label: int, n: int) -> str:
    kinds = ["<p>{}</p>"] * 5 + ["<p><b>{}<br>", "<p>{}", "<li>{}</li>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<td>{}</td>", "<p><a href=x>{}</a> more</p>"]
    return "".join(r.choice(kinds).format(f"[[{label}]]{_sentence(r)}") for _ in range(n))


def _boilerplate(r: random.Random) -> str:
    kind = r.randrange(8)
    text = lambda high=3: _blocks(r, 0, r.randint(1, high))
    bare = f"[[0]]{_sentence(r, 2, 30)}"
    if kind == 0:
        tag, mark = r.choice([("nav", _mark(r, MENU_NAMES, 0.4)), ("div", _mark(r, MENU_NAMES, 1))])
        return f"<{tag}{mark}>{_links(r)}</{tag}>"
    if kind == 1:
        tag, mark = r.choice([("header", _mark(r, HEADER_NAMES, 0.4)), ("div", _mark(r, HEADER_NAMES, 1))])
        return f"<{tag}{mark}>{r.choice([bare, text(), _links(r), f'<h1>{bare}</h1>'])}</{tag}>"
    if kind == 2:
        tag, mark = r.choice([("footer", _mark(r, FOOTER_NAMES, 0.4)), ("div", _mark(r, FOOTER_NAMES, 1))])
        return f"<{tag}{mark}>[[0]]{r.choice(['&copy; ', '© 2024 ', ''])}{_sentence(r, 2, 20)}{r.choice(['', text()])}</{tag}>"
    if kind == 3:
        tag, mark = r.choice([("aside", _mark(r, SIDE_NAMES, 0.5)), ("div", _mark(r, SIDE_NAMES, 1)), ("section", _mark(r, SIDE_NAMES, 1))])
        return f"<{tag}{mark}>{r.choice([bare, text(), _links(r), f'<h3>{bare}</h3>' + text()])}</{tag}>"
    if kind == 4:
        return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'span', 'aside']))}{_mark(r, AD_NAMES, 1)}>{bare if t in ('p', 'span') else r.choice([bare, text()])}</{t}>"
    if kind == 5:
        return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'dialog']))}{_mark(r, NOTICE_NAMES, 1)}>{bare if t == 'p' else r.choice([bare, text()])}</{t}>"
    if kind == 6:
        return f"<form{_mark(r, FORM_NAMES, 0.5)}><label>{bare}</label><input type=text>{r.choice(['', text(2)])}<button>[[0]]{_words(r, 1, 2)}</button></form>"
    tag, inner = r.choice(["section", "div", "ol", "ul", "aside"]), r.choice(["div", "article", "li", "p"])
    each = "".join(f"<{inner}{_mark(r, COMMENT_NAMES, 0.6)}>{bare if inner == 'p' else text(2)}</{inner}>" for _ in range(r.randint(1, 4)))
    return f"<{tag}{_mark(r, COMMENT_NAMES, 1)}>{r.choice(['', f'<h3>{bare}</h3>'])}{each}</{tag}>"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages in which each text block starts with its label in double brackets."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        before = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        after = "".join(_boilerplate(r) for _ in range(r.randint(0, 4)))
        tag, mark = r.choice([("article", ""), ("article", _mark(r, ARTICLE_NAMES)), ("main", ""), ("div", _mark(r, ARTICLE_NAMES, 1)), ("section", _mark(r, ARTICLE_NAMES, 1))])
        body = f"<h1>[[1]]{_words(r, 2, 14)}</h1>" * (r.random() < 0.85)
        for _ in range(r.randint(1, 4)):
            body += _blocks(r, 1, r.randint(1, 6))
            if r.random() < 0.35:
                body += _boilerplate(r)
        wrap = r.choice(["{}", "{}", "<div id=page>{}</div>", "<div class=container>{}</div>", "<main>{}</main>"])
        pages.append("<html><head><title>t</title></head><body>" + wrap.format(f"{before}<{tag}{mark}>{body}</{tag}>{after}") + "</body></html>")
    return pages
