"""Whose pages they are: the verdict against a plain program over random names, states, domains and pages."""

import random
import re
from urllib.parse import urlparse

from wattgrid.operators import resolve

SUFFIX = re.compile(resolve.COMPANY_SUFFIXES[4:], re.IGNORECASE)


def plain_verdict(name, state, domain, pages):
    cleaned = name or ""
    for _ in range(3):
        cleaned = SUFFIX.sub("", cleaned).strip().rstrip(",")
    words = [w for w in cleaned.lower().split() if len(w) > 2 and w not in resolve.PLAIN_WORDS]
    text = " ".join(c.lower() for _, _, c in pages if c)
    if not pages or not words or not text:
        return None
    hits = sum(w in text for w in words)
    head = " ".join(f"{urlparse(u or '').netloc} {urlparse(u or '').path} {t or ''}".lower() for u, t, _ in pages)
    near = sum(w in head for w in words)
    if near >= 2 or (near >= 1 and len(words) <= 2):
        hits = max(hits, near)
    sites = {urlparse(u or "").netloc.replace("www.", "").lower() for u, _, _ in pages} - {""}
    own = (domain or "").replace("www.", "").lower()
    fits = not own or not sites or any(s == own or s.endswith("." + own) or s.split(".")[-2:] == own.split(".")[-2:] for s in sites)
    if hits:
        return None
    state = state or ""
    has_state = state.lower() in text or resolve.NAMED_STATES.get(state.upper(), state.lower()) in text
    others = sum(n in text for c, n in resolve.NAMED_STATES.items() if c != state.upper())
    if has_state and others >= 3 and not fits:
        return "other_states"
    if not has_state:
        return "no_mention" if fits else "nothing_fits"
    return None if fits else "state_only"


def test_verdicts(spark):
    rng = random.Random(1)
    words = ["Acme", "Blue", "Ridge", "City", "of", "Power", "Zed", "électrique", "Co", "Inc.", "LLC", "Valley,"]
    states = [*resolve.NAMED_STATES, "ZZ", "tx", None, "IA"]
    names = list(resolve.NAMED_STATES.values())
    hosts = ["www.acme.com", "rates.acme.com", "other.org", "blue-ridge.com", "deep.sub.other.org"]
    utilities, pages = [], []
    for i in range(400):
        utilities.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) or None, rng.choice(states), rng.choice([None, "", "acme.com", "WWW.Other.org", "a.other.org", "none.test"])))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text = " ".join(rng.choice([*names, "rates", "kwh", "qq"] + (["acme", "Zed"] if rng.random() < 0.2 else [])).title() for _ in range(rng.randint(0, 6)))
            url = rng.choice([None, "no url", f"https://{rng.choice(hosts)}/{rng.choice(['', 'acme/rates', 'x?blue=1'])}"])
            pages.append((i, url, rng.choice([None, "Rates", "Blue Ridge"]), rng.choice([None, "", text, text, text])))
    u = spark.createDataFrame(utilities, "utility_id long, name string, state string, domain string")
    p = spark.createDataFrame(pages, "utility_id long, url string, title string, content string")
    got = {r.utility_id: r for r in resolve.identity_verdicts(u, p).collect()}
    want = {i: plain_verdict(n, s, d, [x[1:] for x in pages if x[0] == i]) for i, n, s, d in utilities}
    assert {i: r.code for i, r in got.items()} == want and set(want.values()) == {None, *resolve.REASONS}
    assert all(r.is_own == (r.code is None) == (r.reason == "") for r in got.values())


def test_names_of_many_words(spark):
    """A name has more words than a number has bits."""
    name = " ".join(f"word{i:03d}" for i in range(150))
    u = spark.createDataFrame([(1, name, "TX", None)], "utility_id long, name string, state string, domain string")
    p = spark.createDataFrame([(1, "http://a.com/", None, "word003 word070"), (1, "http://a.com/", None, "word149 word070")], "utility_id long, url string, title string, content string")
    r = resolve.identity_verdicts(u, p).first()
    assert (r.n_words, r.hits, r.is_own) == (150, 3, True)
