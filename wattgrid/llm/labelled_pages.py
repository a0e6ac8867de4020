"""Labelled pages: layouts written by rule, whose blocks are known to be main text or not."""

from __future__ import annotations

import random

#: Names that pages give to the parts of a layout.
NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs links tabs toc pagination pager skip".split(),
    "header": "header masthead top banner site-header branding logo page-header".split(),
    "footer": "footer bottom site-footer copyright legal colophon".split(),
    "aside": "sidebar aside related widget popular trending recommended rail teaser more-stories tags share social author-box".split(),
    "ad": "ad ads advert advertisement sponsored promo adsbygoogle sponsor banner-ad ad-slot".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr popup modal overlay paywall subscribe-notice".split(),
    "form": "form search newsletter login signup subscribe contact-form".split(),
    "comments": "comments comment comment-list commentlist reply discussion responses disqus user-comments reader-comments".split(),
    "main": "article content post entry main story body post-content entry-content article-body main-content text page-content".split(),
}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "main": "article", "form": "form", "ad": "aside", "notice": "div", "comments": "section"}
#: Attributes that say nothing about what an element holds.
PLAIN = ["", "", ' class="wrap"', ' class="row"', ' class="col-12"', ' class="c-12"', ' class="container"', ' id="app"', ' class="inner"', ' style="margin:0"']
SYLLABLES = "the an re in on er st ti ou le de la que ment ción es und ein ver ge lich pa ré eau da no mi so lu".split()


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """One page and the labels of its leaf blocks in order: 1 for main text."""
    r = random.Random(seed)
    labels: list[int] = []
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def words(n: int) -> str:
        return " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(n)).capitalize()

    def sentence(n: int) -> str:
        return words(n) + r.choice([".", ".", ".", "!", "?", ""])

    def block(html: str, label: int) -> str:
        labels.append(label)
        return html

    def plain(inner: str) -> str:
        named = r.choice(PLAIN) if r.random() < 0.7 else f' class="{word()}"'
        return f"<div{named}>{inner}</div>"

    def wrap(kind: str, inner: str) -> str:
        name = r.choice(NAMES[kind])
        if kind == "main" and r.random() < 0.4:
            return plain(inner) if r.random() < 0.7 else inner
        if kind in ("nav", "header") and r.random() < 0.15:
            return plain(inner)
        if r.random() < 0.5:
            tag = SEMANTIC[kind] if kind != "main" or r.random() < 0.6 else "main"
            named = f' class="{name}"' if r.random() < 0.4 or tag in ("div", "section") or kind == "ad" else ""
        else:
            tag, named = r.choice(["div", "div", "section"]), f' {r.choice(["class", "id"])}="{name}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def links(n: int) -> str:
        if r.random() < 0.7:
            return "<ul>" + "".join(block(f'<li><a href="/{word()}">{words(r.randint(1, 3))}</a></li>', 0) for _ in range(n)) + "</ul>"
        return "".join(block(f'<div><a href="/{word()}">{words(r.randint(1, 4))}</a></div>', 0) for _ in range(n))

    def other(kind: str) -> str:
        if kind == "nav":
            return wrap(kind, links(r.randint(2, 8)))
        if kind == "header":
            return wrap(kind, block(f"<div>{words(r.randint(1, 5))}</div>", 0) + (wrap("nav", links(r.randint(2, 5))) if r.random() < 0.4 else ""))
        if kind == "footer":
            lead = r.choice(["&copy; 2024 ", "Copyright ", "", "&copy; "])
            return wrap(kind, block(f"<p>{lead}{sentence(r.randint(1, 20))}</p>" if r.random() < 0.5 else f"{lead}{sentence(r.randint(1, 20))}", 0) + (links(r.randint(2, 5)) if r.random() < 0.4 else ""))
        if kind == "form":
            return wrap(kind, f'<form>{block(f"<p>{sentence(r.randint(2, 6))}</p>", 0)}<input name="q">{block(f"<button>{words(1)}</button>", 0)}</form>')
        if kind == "comments":
            if r.random() < 0.3:
                inner = "".join(f"<li>{block(f'<div>{words(2)}</div>', 0)}{block(f'<p>{sentence(r.randint(1, 40))}</p>', 0)}</li>" for _ in range(r.randint(1, 4)))
                return f'<ol {r.choice(["class", "id"])}="{r.choice(NAMES[kind])}">{inner}</ol>'
            return wrap(kind, block(f"<h3>{words(2)}</h3>", 0) + "".join(block(f"<p>{sentence(r.randint(1, 40))}</p>", 0) for _ in range(r.randint(1, 4))))
        if kind in ("ad", "notice") and r.random() < 0.5:
            return wrap(kind, block(sentence(r.randint(3, 25)), 0))
        return wrap(kind, (block(f"<h4>{words(2)}</h4>", 0) if r.random() < 0.5 else "") + "".join(block(f"<p>{sentence(r.randint(2, 25))}</p>", 0) for _ in range(r.randint(1, 2))) + (links(r.randint(1, 4)) if r.random() < 0.4 else ""))

    def text() -> str:
        kind, n = r.random(), int(r.choice([1, 2, 6, 15, 40, 80]) * r.uniform(0.7, 1.6)) or 1
        if kind < 0.7:
            inner = sentence(n)
            if r.random() < 0.2:
                inner = f"<b>{inner}<br>" if r.random() < 0.5 else f'{inner} <a href="/x">{words(2)}</a> {sentence(3)}'
            if r.random() < 0.2:
                return plain(block(inner, 1))
            return block(f"<p>{inner}" + ("</p>" if r.random() < 0.85 else ""), 1)
        if kind < 0.8:
            return block(f"<h2>{words(r.randint(1, 6))}</h2>", 1)
        if kind < 0.88:
            return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(block(f"<li>{sentence(r.randint(2, 12))}</li>", 1) for _ in range(r.randint(1, 4))))
        if kind < 0.9:
            return block(f"<pre>{sentence(n)}</pre>", 1)
        if kind < 0.94:
            return f"<blockquote>{block(f'<p>{sentence(n)}</p>', 1)}</blockquote>"
        return "<table><tr>" + "".join(block(f"<td>{words(r.randint(1, 4))}</td>", 1) for _ in range(r.randint(1, 4))) + "</tr></table>"

    def article() -> str:
        inner = block(f"<h1>{words(r.randint(2, 9))}</h1>", 1) if r.random() < 0.7 else ""
        if r.random() < 0.08:
            return wrap("main", inner + block("<br><br>".join(sentence(r.randint(8, 80)) for _ in range(r.randint(1, 4))), 1))
        if r.random() < 0.2:
            for _ in range(r.randint(2, 5)):
                inner += r.choice(["<section>{}</section>", "<div>{}</div>"]).format("".join(text() for _ in range(r.randint(1, 3))))
            return wrap("main", inner)
        for _ in range(r.choice([1, 1, r.randint(1, 9), r.randint(1, 9), r.randint(1, 9)])):
            inner += text()
            if r.random() < 0.08:
                inner += other(r.choice(["ad", "aside", "form", "nav"]))
        if r.random() < 0.15:
            inner += other("comments")
        return wrap("main", inner)

    above, below = (0.5 if r.random() < 0.7 else 0.0), (0.5 if r.random() < 0.8 else 0.0)
    page = "".join(other(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < above)
    main = article()
    for _ in range(r.choice([0, 0, 1, 2])):
        main = plain(main)
    page += main
    page += "".join(other(k) for k in ("comments", "aside", "form", "nav", "ad", "footer", "notice") if r.random() < below)
    for _ in range(r.choice([0, 0, 1, 2])):
        page = plain(page)
    return f"<html><head><title>{words(3)}</title></head><body>{page}</body></html>", labels


def labelled_pages(n: int, first: int = 0) -> list[tuple[str, list[int]]]:
    return [labelled_page(s) for s in range(first, first + n)]
