"""Labelled pages to train on: seeded layouts of many kinds around invented prose."""

from __future__ import annotations

import html
import random

_SYLLABLES = "an ar be ca de el en er es fi ga ha in is ka la le lo ma mi na ne no on or pa ra re ri sa se ta te ti to un ve wa ze".split()
_MENU = "Home News About Contact Archive Products Support Careers Shop Blog Help Login".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    return (" ".join(words)).capitalize() + r.choice("...!?")


def _prose(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice((1, 1, 2, 3, 4, 6))))
    kind = r.random()
    if kind < 0.08:
        return " ".join(w + r.choice(("***", "%%%", "$$$", "###", "&&&", "!!")) for w in text.split())
    if kind < 0.14:
        return " | ".join(_word(r) for _ in range(r.randint(2, 12)))
    if kind < 0.2:
        return _sentence(r, 1, 2)
    if kind < 0.24:
        return text.upper()
    return text


def _label(r: random.Random, low: int = 1, high: int = 3) -> str:
    return r.choice(_MENU) if r.random() < 0.3 else " ".join(_word(r) for _ in range(r.randint(low, high)))


def _anchor(r: random.Random) -> str:
    return f'<a href="/{_word(r)}">{html.escape(_label(r))}</a>'


def _any(r: random.Random) -> str:
    """Text that any side part may hold: short, or like prose."""
    return html.escape(_prose(r) if r.random() < 0.6 else _label(r, 1, 6))


def _side(r: random.Random, kind: str) -> str:
    links = "".join(f"<li>{_anchor(r)}</li>" for _ in range(r.randint(2, 8)))
    name = r.choice
    if kind == "menu":
        return name((f"<nav><ul>{links}</ul></nav>", f'<div class="{name(("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav"))}">{name((f"<ul>{links}</ul>", " &raquo; ".join(_anchor(r) for _ in range(4))))}</div>', f'<ul id="{name(("menu", "nav"))}">{links}</ul>'))
    if kind == "header":
        return name((f"<header>{_inner(r)}</header>", f'<div class="{name(("header", "site-header", "masthead", "top", "banner", "topbar", "page-header"))}">{_inner(r)}</div>', f'<div id="{name(("header", "masthead", "top"))}">{_inner(r)}</div>'))
    if kind == "footer":
        body = name((f"&copy; {_word(r)} &middot; {_any(r)}", f"<p>{_any(r)}</p><ul>{links}</ul>", f"{_any(r)}"))
        return name((f"<footer>{body}</footer>", f'<div class="{name(("footer", "site-footer", "copyright", "bottom", "legal"))}">{body}</div>', f'<div id="footer">{body}</div>'))
    if kind == "sidebar":
        body = name((f"<h3>{_any(r)}</h3><ul>{links}</ul>", _inner(r), f"<p>{_any(r)}</p>"))
        return name((f"<aside>{body}</aside>", f'<div class="{name(("sidebar", "side", "widget", "related", "recommended", "rail", "tags", "share", "social", "trending", "popular", "more"))}">{body}</div>', f'<aside class="sidebar">{body}</aside>', f'<div id="sidebar">{body}</div>', f'<section class="{name(("related", "recommended", "sidebar"))}">{body}</section>'))
    if kind == "advert":
        return f'<div class="{name(("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad banner", "ad-slot", "adbox"))}">{_inner(r)}</div>'
    if kind == "notice":
        return f'<div {name(("class", "id"))}="{name(("cookie", "cookies", "cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "banner", "overlay", "paywall", "warning", "message"))}">{_inner(r)}{name(("", "<button>OK</button>"))}</div>'
    if kind == "form":
        return f'<form action="/{_word(r)}"{name(("", " class=search", " id=login"))}><label>{_any(r)}</label><input name="q"><p>{_any(r)}</p><button>{_label(r)}</button></form>'
    if kind == "comments":
        one = lambda: name((f'<div class="comment"><b>{_word(r)}</b><p>{_any(r)}</p></div>', f'<li class="comment"><p>{_any(r)}</p></li>', f"<article><p>{_any(r)}</p></article>", f"<p>{_any(r)}</p>"))
        body = "".join(one() for _ in range(r.randint(1, 5)))
        return name((f'<section class="{name(("comments", "comment-list", "responses", "discussion", "replies"))}"><h2>{_any(r)}</h2>{body}</section>', f'<div id="{name(("comments", "disqus", "responses", "discussion"))}">{body}</div>', f'<ol class="commentlist">{body}</ol>', f'<div class="{name(("comments", "comment", "user-comments", "reply", "reviews"))}">{body}</div>'))
    return ""


def _inner(r: random.Random) -> str:
    t = _any(r)
    return r.choice((t, f"<p>{t}</p>", f"<h2>{t}</h2><p>{_any(r)}</p>", f"<p>{t}</p><p>{_any(r)}</p>", f"<div>{t}</div>", f"<span>{t}</span>", f"{t} {_anchor(r)}"))


def _article(r: random.Random) -> list[str]:
    """Content blocks; each is kept whole and labelled 1."""
    out = [f"<h1>{html.escape(_sentence(r, 2, 9))}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
        text = html.escape(_prose(r))
        if r.random() < 0.2:
            words = text.split()
            k = r.randrange(len(words))
            words[k] = r.choice((f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f'<a href="/x">{words[k]}</a>', f"{words[k]}<br>"))
            text = " ".join(words)
        kind = r.random()
        out.append(f"<h2>{text}</h2>" if kind < 0.06 else f"<ul><li>{text}</li><li>{html.escape(_prose(r))}</li></ul>" if kind < 0.12 else f"<blockquote><p>{text}</p></blockquote>" if kind < 0.15 else f"<pre>{text}</pre>" if kind < 0.17 else f"<table><tr><td>{text}</td><td>{_word(r)}</td></tr></table>" if kind < 0.2 else f"<p><b>{text}<br>" if kind < 0.24 else f"<div>{text}</div>" if kind < 0.28 else f"<p>{text}</p>")
    return out


#: Stands in the trained pages' text where a part without content begins and ends.
SKIP, TAKE = "\ue000", "\ue001"


def labelled(r: random.Random) -> str:
    """A page; ``SKIP`` and ``TAKE`` stand at the start of each text of a side part or of the article."""
    part = lambda *among: _marked(_side(r, r.choice(among)), SKIP)
    article = [_marked(x, TAKE) for x in _article(r)]
    if r.random() < 0.35:
        article.insert(r.randrange(len(article) + 1), part("advert", "notice", "form", "sidebar", "menu"))
    if r.random() < 0.2:
        article.append(part("comments"))
    if r.random() < 0.12:
        article.append(part("footer"))
    if r.random() < 0.08:
        article.insert(0, part("menu"))
    body = "".join(article)
    around = r.choice(("<article>{}</article>",) * 6 + ("<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="article">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', '<div class="main text">{}</div>', "<div>{}</div>", "{}", '<div class="article-body">{}</div>', '<div id="main">{}</div>'))
    before = "".join(part("menu", "header", "advert", "notice", "form", "sidebar") for _ in range(r.randint(0, 4)))
    after = "".join(part("footer", "comments", "sidebar", "advert", "notice", "form", "menu") for _ in range(r.randint(0, 4)))
    wrap = r.choice(("{}",) * 3 + ('<div class="wrapper">{}</div>', '<div id="page">{}</div>', '<div class="container">{}</div>'))
    return f"<!DOCTYPE html><html><head><title>{_word(r)}</title><style>p{{}}</style></head><body><!-- x -->{wrap.format(before + around.format(body) + after)}</body></html>"


def _marked(part: str, mark: str) -> str:
    """``part`` with ``mark`` before each of its words."""
    import re

    return re.sub(r">([^<]+)", lambda m: ">" + re.sub(r"(\S+)", lambda w: mark + w[1], m[1]), part) if part.startswith("<") else part
