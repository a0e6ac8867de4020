"""Blocks of odd pages, their time, and the chain's sums and best labels against enumeration."""

import itertools
import time

import numpy as np
import pytest

from wattgrid.llm.html_blocks import leaf_blocks
from wattgrid.llm.html_text import Field, default_field, likelihood, main_text


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>one</p><video-player></video-player><p>two</p>", ["one", "two"]),
        ("<p>one</p><select-menu></select-menu><p>two</p>", ["one", "two"]),
        ("<p>one</p><svg/><p>two</p>", ["one", "two"]),
        ("<p>one<svg viewBox='0 0 1 1'><title>no</title><path d='M0'/><text>no</text></svg> more</p>", ["one", "more"]),
        ("<div><p>one</p><video src=x></div><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>if (a < b) document.write('</scripty><p>no</p>')</script><p>two</p>", ["one", "two"]),
        ("<p>one</p><style>no", ["one"]),
        ("<p>a < b and c <= d <3</p>", ["a < b and c <= d <3"]),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p>", ["x", "y"]),
        ("<!-- <p>no</p> --><p>x</p><!--><p>y</p><!-- no", ["x", "y"]),
        ("<p>x &amp;amp; &eacute;&#x41;</p>", ["x &amp; éA"]),
        ("<p>x</p><!doctype html><?php no ?></><p>y</p>", ["x", "y"]),
        ("<ul><li>a<li>b<p>c</ul>d<table><tr><td>e<td>f</table>", ["a", "b", "c", "d", "e", "f"]),
        ("text <b>bold</b><br>line <div", ["text bold line"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a ">" ', "<div>x", "<svg>", "<svg/>x", "<!", "<!--", "</p", "<script>", "<li>x<div>", "</li></ul>", "<p class='a hidden'>x", "<script><", "<div class=c%d>x"])
def test_time_grows_with_the_page(unit):
    page = "".join(unit % i if "%d" in unit else unit for i in range(1_000_000 // len(unit)))
    field = default_field()
    began = time.process_time()
    main_text(page, field)
    assert time.process_time() - began < 12


def test_a_tag_that_never_ends():
    began = time.process_time()
    assert leaf_blocks("<p>x</p>" + "<a " * 1_000_000)[0].text == "x" and time.process_time() - began < 1


def enumerated(w, x, y):
    """Log-likelihood of labels y, and the best labels, from all label sequences of one page."""
    step = w[-5:-1].reshape(2, 2)

    def score(labels):
        own = sum((x[t] @ w[:-5] + (w[-1] if t == 0 else 0)) * a for t, a in enumerate(labels))
        return own + sum(step[a, b] for a, b in zip(labels, labels[1:]))

    every = {labels: score(labels) for labels in itertools.product((0, 1), repeat=len(x))}
    return every[tuple(y)] - np.log(sum(np.exp(list(every.values())))), max(every, key=every.get)


def test_sums_slopes_and_best_labels_match_enumeration():
    rng = np.random.default_rng(5)
    lengths, n_features = [1, 2, 5, 7], 6
    for _ in range(5):
        w = rng.normal(size=n_features + 5)
        x, there = np.zeros((4, 7, n_features)), np.zeros((4, 7), bool)
        y = np.zeros((4, 7), int)
        for p, n in enumerate(lengths):
            x[p, :n], there[p, :n], y[p, :n] = rng.integers(0, 2, (n, n_features)), True, rng.integers(0, 2, n)
        total = lambda v: sum(enumerated(v, x[p, :n], y[p, :n])[0] for p, n in enumerate(lengths))  # noqa: E731, B023
        value, slope = likelihood(w, x, y, there)
        assert np.isclose(value, total(w))
        numeric = [(total(w + 1e-5 * e) - total(w - 1e-5 * e)) / 2e-5 for e in np.eye(len(w))]
        assert np.allclose(slope, numeric, atol=1e-5)
        step = tuple(tuple(r) for r in w[-5:-1].reshape(2, 2))
        for p, n in enumerate(lengths):
            assert tuple(Field({}, step, w[-1]).viterbi([float(x[p, t] @ w[:-5]) for t in range(n)])) == enumerated(w, x[p, :n], y[p, :n])[1]
