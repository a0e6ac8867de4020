"""Packing of tokenized documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Tokens that a task holds before it packs them: memory of a task, whatever the input.
HORIZON_TOKENS = 4_000_000
#: A window with more free places than this is cut into sequences whose lengths are powers of two, which need no padding.
MOST_FREE = 32
#: Words that a Python worker remembers, each with a few ids: about 200 bytes a word, in two tables.
CACHED_WORDS = 900_000

_encoders: dict[tuple[str, int], WordEncoder] = {}


def trim(known: dict, most: int) -> None:
    """Forgets the older half of a table that holds more than ``most``."""
    if len(known) > most:
        for key in list(islice(known, len(known) // 2)):
            del known[key]


class WordEncoder:
    """Token ids (little-endian unsigned 32-bit bytes) of whole texts; a word between white space is encoded once while it is remembered.

    Valid for tokenizers that drop white space and let no token span it. Texts with characters that Python and the
    tokenizer split differently, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.splits: dict[str, bool] = {}

    @classmethod
    def of(cls, path: str, most: int = CACHED_WORDS) -> WordEncoder:
        if (path, most) not in _encoders:
            _encoders[path, most] = cls(path, most)
        return _encoders[path, most]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def parts_from_stop(self, c: str) -> bool:
        """Whether a stop or comma after this character is a piece of its own."""
        if c not in self.splits:
            alone, both = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (c, c + "."))
            self.splits[c] = len(alone) < len(both) and both[: len(alone)] == alone
        return self.splits[c]

    def plain(self, cores: list[str]) -> None:
        """Encodes runs of letters, many in one text; their last tokens are marked in the vocabulary."""
        for i in range(0, len(cores), 2000):
            some = cores[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                self.cores.update(zip(some, (raw[a:b] for a, b in zip(at, at[1:]))))
            else:
                self.cores.update(zip(some, self.whole(some)))

    def learn(self, words: set[str]) -> None:
        trim(self.cores, self.most)
        cores, tails, letters, other, known = [], [], set(), set(), self.cores
        for w in words:
            core = w.rstrip(".,")
            if len(core) < len(w) and core and not core[-1].isascii() and not self.parts_from_stop(core[-1]):
                core = w
            if core.isalpha():  # letters alone: one piece, and A to Z encode as a to z
                if core.isascii():
                    core = core.lower()
                    if core not in known:
                        letters.add(core)
                elif core not in known:
                    (letters if core.lower().isalpha() and unicodedata.is_normalized("NFC", core) else other).add(core)
            else:
                if not (core and core[-1].isalpha()):
                    core = w
                if core not in known:
                    other.add(core)
            cores.append(core)
            tails.append(w[len(core) :])
        other |= {t for t in set(tails) if t and t not in known}
        self.plain(list(letters))
        more = list(other)
        known.update(zip(more, self.whole(more)))
        self.words.update(zip(words, [known[c] + known[t] if t else known[c] for c, t in zip(cores, tails)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") or any(s in t for s in self.special) for t in texts]
        lists = [[] if o else t.split() for t, o in zip(texts, odd)]
        words = self.words
        found = [list(map(words.get, ws)) for ws in lists]
        new = {w for ws, ids in zip(lists, found) if None in ids for w, x in zip(ws, ids) if x is None}
        if new:
            self.learn(new)
            found = [[words[w] if x is None else x for w, x in zip(ws, ids)] if None in ids else ids for ws, ids in zip(lists, found)]
        out = [b"".join(ids) for ids in found]
        trim(self.words, self.most)
        for i, t in enumerate(texts):
            if odd[i]:
                out[i] = self.whole([t])[0]
        return out


class TightestFit:
    """Open windows by free places, under a segment tree that finds the smallest number of free places not below a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.filled = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, window: int) -> None:
        self.open[free].append(window)
        k = self.size + free
        while k and not self.filled[k]:
            self.filled[k] = 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(free places, window) of the tightest open window that holds length; it is no longer open."""
        k, filled = self.size + length, self.filled
        while not filled[k]:
            while k & 1:  # the right end of its parent: go up until there is something to the right
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if filled[2 * k] else 2 * k + 1
        free = k - self.size
        window = self.open[free].pop()
        if not self.open[free]:
            while k and not (k < self.size and (filled[2 * k] or filled[2 * k + 1])):
                filled[k] = 0
                k >>= 1
        return free, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indexes of the lengths in each window; equal lengths in the order given."""
    tree, windows = TightestFit(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if found := tree.take(lengths[i]):
            free, w = found
            windows[w].append(i)
        else:
            free, w = window, len(windows)
            windows.append([i])
        if free > lengths[i]:
            tree.add(free - lengths[i], w)
    return windows


def sequences(rests: list[tuple[int, bytes]], window: int, most_free: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Packs (key, ids) into sequences of (key, places into the given ids, ids)."""
    for members in best_fit_decreasing([len(ids) // 4 for _, ids in rests], window):
        used = sum(len(rests[i][1]) // 4 for i in members)
        if window - used <= most_free:
            yield [(rests[i][0], 0, rests[i][1]) for i in members]
            continue
        parts = [(rests[i][0], 0, rests[i][1]) for i in members]
        for k in reversed(range(used.bit_length())):
            left, chosen = used & (1 << k), []
            while left:
                key, at, ids = parts.pop(0)
                n = min(left, len(ids) // 4)
                chosen.append((key, at, ids[: 4 * n]))
                if 4 * n < len(ids):
                    parts.insert(0, (key, at + n, ids[4 * n :]))
                left -= n
            if chosen:
                yield chosen


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, horizon: int = HORIZON_TOKENS, most_free: int = MOST_FREE, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and end_id. Full windows are cut off its front; the rests of all documents of a task are
    packed longest first, each into the tightest open window that holds it. Windows that stay emptier than most_free
    are cut into sequences of power-of-two lengths. Tasks pack what they read, in portions of horizon tokens, so nothing is
    shuffled and memory does not grow with the input. vocabulary is the path of a tokenizer file on every executor;
    cached_words bounds the words that each of its Python workers remembers, which costs time but changes no result.

    Null and empty texts are documents of end_id alone. Ids are numbers and may be null or repeat: each row is a document of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(vocabulary, cached_words), np.asarray([end_id], "<u4").tobytes()
        next_id, full = TaskContext.get().partitionId() << 33, 4 * window
        rows: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def put(pieces: list[tuple[tuple, int, bytes]]) -> None:
            nonlocal next_id
            offset = 0
            for (doc, base, tokens), at, ids in pieces:
                n = len(ids) // 4
                rows.append((doc, base + at, n, zlib.crc32(ids), tokens, next_id, offset))
                offset += n
            next_id += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in schema.split(", ")])
            rows.clear()
            return made

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids_of), 128):
                for doc, ids in zip(ids_of[i : i + 128], encoder.encode([t or "" for t in texts.slice(i, 128).to_pylist()])):
                    ids += end
                    tokens, cut = len(ids) // 4, len(ids) // full * full
                    for a in range(0, cut, full):
                        put([((doc, a // 4, tokens), 0, ids[a : a + full])])
                    if cut < len(ids):
                        rests.append(((doc, cut // 4, tokens), ids[cut:]))
                        held += len(ids) - cut
                if held >= 4 * horizon:
                    for s in sequences(rests, window, most_free):
                        put(s)
                    rests, held = [], 0
                if len(rows) >= 20_000:
                    yield out()
        for s in sequences(rests, window, most_free):
            put(s)
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
