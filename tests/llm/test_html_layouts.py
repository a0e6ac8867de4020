"""Main text of layouts that the training pages don't have: templates and words of another kind, and pages without any names."""

import random
from collections import Counter

import pytest

from wattgrid.llm.html_text import default_field, main_text

LONG = "This is a long paragraph about the history of the valley, and about the people who have lived there since the war ended."
WORDS = {
    "en": "the river council voted after a long debate to restore old bridges near market square because winter floods had damaged stone arches and local shops".split(),
    "de": "der Rat hat nach langer Debatte beschlossen die alten Brücken am Marktplatz zu sanieren weil das Hochwasser im Winter viele Bögen beschädigt hat".split(),
    "fr": "le conseil a décidé après un long débat de rénover les vieux ponts près de la place parce que les crues avaient abîmé plusieurs arches".split(),
}


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="wrap"><div class="c-12"><p>{LONG}</p><p>{LONG}</p></div></div>', f"{LONG} {LONG}"),
        (f'<div class="inhalt"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG} {LONG}"),
        (f"<div><p>{LONG}</p></div>", LONG),
        (LONG, LONG),
        (f"<article><pre>{LONG}</pre></article>", LONG),
        (f'<article><p>{LONG}</p></article><ol class="commentlist"><li><p>nice post, I liked it</p></li></ol><footer>x</footer>', LONG),
        (f'<p>{LONG}<span style="display:none">no <span>more</span> of it</span> Seen.</p>', f"{LONG} Seen."),
        (f'<p>{LONG}<span hidden>no</p><p>{LONG}</p>', f"{LONG} {LONG}"),
        (f'<div><div><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div><div><p>{LONG}</p><p>{LONG}</p></div></div>', f"{LONG} {LONG}"),
    ],
)
def test_pages_without_known_names(page, want):
    assert main_text(page, default_field()) == want


def written(r: random.Random) -> tuple[str, str]:
    """A page and its main text; five templates."""
    words = WORDS[r.choice(list(WORDS))]
    say = lambda n: (" ".join(r.choice(words) for _ in range(n)) + ".").capitalize()
    body = [say(r.randint(20, 70)) for _ in range(r.randint(2, 6))]
    title = " ".join(r.choice(words) for _ in range(5))
    menu = "".join(f'<li class="menu-item"><a href="/{k}">{r.choice(words)}</a></li>' for k in range(r.randint(3, 8)))
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    kind = r.randrange(5)
    if kind == 0:  # a blog
        side = "".join(f'<li><a href="/p/{k}">{" ".join(r.choice(words) for _ in range(4))}</a></li>' for k in range(5))
        page = f'<body class="home blog"><div id="page" class="hfeed site"><div id="masthead" class="site-header"><h2>{r.choice(words)}</h2></div><nav id="nav"><ul>{menu}</ul></nav><div id="primary"><div class="hentry"><h1>{title}</h1>{paragraphs}</div></div><div id="secondary" class="widget-area"><h3>Recent</h3><ul>{side}</ul></div><div id="colophon">&copy; 2021 {r.choice(words)}</div></div></body>'
    elif kind == 1:  # a grid of rows and columns
        page = f'<body><div class="navbar navbar-default"><ul>{menu}</ul></div><div class="container-fluid"><div class="row"><div class="col-md-8"><h1>{title}</h1>{paragraphs}</div><div class="col-md-4 sidebar"><p>{say(6)}</p></div></div></div><footer><p>{say(8)}</p></footer></body>'
    elif kind == 2:  # divs for everything
        page = f'<body><div class="x1"><div class="x2"><ul>{menu}</ul></div><div class="x3"><div>{title}</div>' + "".join(f"<div>{b}</div>" for b in body) + f'</div><div class="x4"><a href="/i">Impressum</a> <a href="/d">Kontakt</a></div></div></body>'
    elif kind == 3:  # sections with heads, reader comments behind
        parts = "".join(f"<section><p>{b}</p></section>" for b in body)
        notes = "".join(f'<li class="comment"><cite>{r.choice(words)}</cite><p>{say(12)}</p></li>' for _ in range(3))
        page = f'<body><header><a href="/">{r.choice(words)}</a></header><main><h1>{title}</h1>{parts}</main><div id="comments"><ol class="comment-list">{notes}</ol></div></body>'
    else:  # a plain page
        page = f"<body><h1>{title}</h1>{paragraphs}</body>"
    return page, " ".join([title, *body])


def test_words_of_pages_by_another_hand():
    r, field = random.Random(11), default_field()
    both = got_all = want_all = 0
    for _ in range(300):
        page, want = written(r)
        a, b = Counter(main_text(page, field).split()), Counter(want.split())
        both, got_all, want_all = both + sum((a & b).values()), got_all + sum(a.values()), want_all + sum(b.values())
    assert both / want_all > 0.95 and both / got_all > 0.95, (both / want_all, both / got_all)
