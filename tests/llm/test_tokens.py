"""Encoders against the tokenizers library over random texts, and the memory of the streaming one."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wattgrid.llm import bpe
from wattgrid.llm.bpe import Transducer, chunks_of, sufficient_lookahead
from wattgrid.llm.packing import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "B", "'", "'t", "'re", "'ll", " ", "  ", "\n", "\t", "1", "22", "é", "日", "\U00018e37", "<|endoftext|>", "<|endo", "!", "?!", "　", "İ.", "İ,", "\x1c", "\x85", "the", " the", "\xa0", "²", "🙂", "ŉ", "̇"]


@pytest.fixture(scope="module")
def machine():
    return Transducer.of(BYTES)


def any_char(rng):
    return chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000), rng.randrange(0x10000, 0x20000)]))


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) if k % 2 else any_char(rng) for _ in range(rng.randint(0, 30))) for k in range(n)]


def ids_of(machine, text, step):
    return np.frombuffer(b"".join(machine.encode(text[i : i + step] for i in range(0, len(text), step))), "<u4").tolist()


def test_chunks_of_any_size_encode_as_the_library_does(machine):
    tok = Tokenizer.from_file(BYTES)
    texts = random_texts(1, 20_000)
    for k, (text, want) in enumerate(zip(texts, tok.encode_batch(texts, add_special_tokens=False))):
        assert ids_of(machine, text, [1, 2, 3, 7, 1000][k % 5]) == want.ids, text


def test_pieces_that_go_on(machine, monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 8)
    tok, rng = Tokenizer.from_file(BYTES), random.Random(2)
    for k in range(200):
        bits = [["a", "b", "th", "ing"], ["!", "?", "--"], ["1", "23"], [" ", "\n", "\t"], ["é", "ing", "日"], "abcdefghijklmnopqrstuvwxyz"][k % 6]
        text = " x" * rng.randint(0, 2) + "".join(rng.choice(bits) for _ in range(rng.randint(500, 2500))) + rng.choice(["", " ", "x", "'t", " y", "\n", "<|endoftext|>"])
        assert ids_of(machine, text, [5, 50, 700][k % 3]) == tok.encode(text, add_special_tokens=False).ids


def test_tokens_are_stable_after_the_lookahead(machine):
    """Whatever follows a cut, the tokens that end before it by the lookahead are those of the part before it."""
    rng = random.Random(3)
    token = lambda: machine.bytes_of[rng.randrange(50_000)]
    for _ in range(300):
        text = b"".join(token() for _ in range(200))
        cut = rng.randint(machine.lookahead + 1, len(text))
        ends = lambda raw: np.cumsum([len(machine.bytes_of[t]) for t in machine.tokens(raw)])
        a, b = ends(text[:cut]), ends(text)
        assert set(a[a <= cut - machine.lookahead]) == set(b[b <= cut - machine.lookahead])


def test_lookahead_of_small_lists():
    assert sufficient_lookahead([]) == 0 and sufficient_lookahead([(b"a", b"b")]) == 1
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # abc: bc takes b from ab, so a waits for c
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"a", b"b"), (b"ab", b"a"), (b"b", b"a"), (b"a", b"ba")])


@pytest.mark.parametrize("unit", ["qzxj", "word and ", "   ", "-+"])
def test_memory_does_not_grow_with_the_text(machine, unit):
    def peak(n):
        tracemalloc.start()
        count = sum(len(x) for x in machine.encode(unit * (8192 // len(unit)) for _ in range(n)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, count

    small, large = peak(2), peak(8)
    assert large[1] > 3 * small[1] and large[0] < 1.5 * small[0] + 100_000


def test_texts_are_taken_up_in_chunks():
    text = pa.array(["é日" * 50_000])[0]
    assert "".join(chunks_of(text)) == "é日" * 50_000 and max(map(len, chunks_of(text))) <= bpe.CHUNK and list(chunks_of(pa.array([None], pa.string())[0])) == []


def test_words_encode_as_the_library_does():
    tok, encoder = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    texts = random_texts(4, 20_000) + [f"{c}{stop} x" for c in "İŉǰẖßΣς" for stop in (".", ",", ".,")]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        for text, got, want in zip(some, encoder.encode(some), tok.encode_batch(some, add_special_tokens=False)):
            assert got == np.asarray(want.ids, "<u4").tobytes(), text
