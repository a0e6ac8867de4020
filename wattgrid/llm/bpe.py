"""Byte-level BPE: a streaming encoder with bounded lookahead, and an incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.packing import trim

#: Pieces, and pairs of tokens, that a Python worker remembers: about 200 bytes each.
CACHED_PIECES = 600_000
#: Bytes of text that are taken up at once; bytes beyond the lookahead that the encoder gathers; characters of an unfinished piece that wait.
CHUNK, STEP, HELD = 1 << 16, 512, 1024
#: Code points from here on, but for the tags, are unassigned or private in every version of Unicode.
ASSIGNED, TAGS = 0x40000, range(0xE0000, 0xE1000)
#: Fixed value: how the vocabulary's pre-tokenizer splits texts, with the insides of its sets of letters, numbers and white space left open.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

_machines: dict[str, "Transducer"] = {}


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token is stable whatever follows, for a list in which each token has one merge, after those of its halves.

    Such a list can be applied merge by merge. Take a text, and the same text cut off at n. As bytes they agree up to n, and
    merge (u, v) shortens the part that agrees only if u ends that part and v begins right after it in one of the two; then
    by len(u). The next merge that does so is later in the list, and its right half begins where this u began, so u
    is on the left edge of that half: the half itself, its left half, the left half of that, and so on. The lookahead is the
    largest sum of len(u) over such chains, found in the order of the list from the best chain that ends with each u.
    """
    left: dict[bytes, bytes] = {}
    best: dict[bytes, int] = {}
    for u, v in merges:
        if u + v in left or any(len(x) > 1 and x not in left for x in (u, v)):
            raise ValueError(f"{u + v!r} has two merges, or one before those of its halves")
        edge, reach = v, best.get(v, 0)
        while edge in left:
            edge = left[edge]
            reach = max(reach, best.get(edge, 0))
        best[u] = max(best.get(u, 0), len(u) + reach)
        left[u + v] = u
    return max(best.values(), default=0)


class Splitter:
    """Cuts text into pieces as the pre-tokenizer ``cut`` does; what are letters, numbers and white space is asked of it once."""

    def __init__(self, cut: Callable[[str], list]):
        import regex

        text = "".join(map(chr, [*range(0xD800), *range(0xE000, ASSIGNED), *TAGS]))
        sets: dict[str, str] = {"L": "", "N": "", "O": "", "S": ""}
        own, usual = np.full(len(text), "O"), np.full(len(text), "O")
        for _, (a, b) in cut(text):  # a piece is a run of one kind, but for a blank before it
            for x, y in [(a, a + 1), (a + 1, b)] if text[a] == " " else [(a, b)]:
                if x < y:
                    kind = next((k for k, probe in zip("LNO", "a1!") if len(cut(probe + text[x])) == 1 and text[x] != " "), "S")
                    own[x:y] = kind
                    sets[kind] += rf"\U{ord(text[x]):08x}-\U{ord(text[y - 1]):08x}"
        classes = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}
        for kind, inside in classes.items():
            for m in regex.finditer(f"{inside}+", text):
                usual[m.start() : m.end()] = kind
        #: For texts without characters that the regular expressions' own tables class otherwise: the same pieces, sooner.
        self._usual = regex.compile(SPLIT.format(**classes)).findall
        self._exact = regex.compile(SPLIT.format(**sets)).findall
        self._odd = frozenset(text[i] for i in np.flatnonzero(own != usual))
        self.run = {k: regex.compile(f"[{sets[k]}]*").match for k in "LNS"} | {"O": regex.compile("[^{L}{N}{S}]*".format(**sets)).match}

    def pieces(self, text: str) -> list[str]:
        return self._usual(text) if text.isascii() or self._odd.isdisjoint(text) else self._exact(text)

    def kind(self, char: str) -> str:
        return next(k for k in "LNOS" if self.run[k](char).end())


class Transducer:
    """Encodes with a merge list as text streams in, and decodes as ids do.

    Text is split into pieces as soon as no further text can change the split; a piece that goes on is passed on in parts.
    The encoder gathers bytes of a piece until it holds ``lookahead`` and STEP of them, encodes these, and emits the
    tokens that end ``lookahead`` bytes before the last: they are stable, as no merge of the whole piece crosses their ends, and
    what follows them encodes by itself. The end of a piece settles the rest. So all that a machine holds of a text is one
    chunk and ``lookahead`` + STEP bytes; besides, it remembers the tokens of pieces (at most CACHED_PIECES).
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = printable_bytes()
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.id_of: dict[bytes, int] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
            self.id_of[raw(token)] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["model"]["merges"]]
        self.lookahead = sufficient_lookahead((raw(a), raw(b)) for a, b in pairs)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.id_of))
        self.reach: dict[bytes, int] = {}  # the longest token by the first two bytes
        for token in self.id_of:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.window = self.lookahead + max(STEP, self.longest)
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in _machines:
            _machines[path] = cls(path)
        return _machines[path]

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a few bytes, by applying the first merge of the list as long as there is one."""
        ids, get = [self.first[b] for b in piece], self.merges.get
        pairs = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best = min((p for p in pairs if p), default=None)
            if best is None:
                return ids
            k = 0
            while True:
                try:
                    k = pairs.index(best, k)
                except ValueError:
                    break
                ids[k : k + 2] = [best[1]]
                del pairs[k]
                if k < len(pairs):
                    pairs[k] = get((ids[k], ids[k + 1]))
                if k:
                    pairs[k - 1] = get((ids[k - 1], ids[k]))

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b comes after a (or, for -1, first) in encodings: whether both together encode to just the two."""
        if (a, b) not in self.follows:
            trim(self.follows, CACHED_PIECES)
            self.follows[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b] if a >= 0 else self.merged(self.bytes_of[b]) == [b]
        return self.follows[a, b]

    def tokens(self, held: bytes) -> list[int]:
        """Tokens of the bytes held: an encoding is the one sequence in which each token may follow the one before; the longest are tried first, going back where none may."""
        tokens: list[int] = []
        dead: set[int] = set()  # places from which no tokens lead to the end
        at, n, reach, get, follows = 0, len(held), self.reach.get, self.id_of.get, self.follows
        size = min(n, reach(held[:2], 1))
        while at < n:
            last = tokens[-1] if tokens else -1
            while size:
                t = get(held[at : at + size])
                if t is not None and at + size not in dead:
                    may = follows.get((last, t))
                    if may or may is None and self.may_follow(last, t):
                        break
                size -= 1
            if size:
                tokens.append(t)
                at += size
                size = min(n - at, reach(held[at : at + 2], 1))
            else:
                dead.add(at)
                size = len(self.bytes_of[tokens.pop()])
                at -= size
                size -= 1
        return tokens

    def stream(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that arrives in parts, each emitted once it is stable."""
        held = bytearray()
        for part in parts:
            for i in range(0, len(part), STEP):
                held += part[i : i + STEP]
                while len(held) >= self.window:
                    stable, end = [], 0
                    for t in self.tokens(bytes(held[: self.window])):
                        if end + len(self.bytes_of[t]) > self.window - self.lookahead:
                            break
                        stable.append(t)
                        end += len(self.bytes_of[t])
                    yield stable
                    del held[:end]
        yield self.tokens(bytes(held))

    def whole(self, piece: str) -> bytes:
        """Ids of a piece that has come whole; short ones are remembered."""
        ids = self.known.get(piece)
        if ids is None:
            ids = b"".join(struct.pack(f"<{len(some)}I", *some) for some in self.stream([piece.encode()]))
            if len(piece) <= HELD:
                self.known[piece] = ids
        return ids

    def _pieces(self, parts: Iterable[tuple[str, bool]]) -> Iterator[list[str] | tuple[str, bool]]:
        """Lists of whole pieces, and (text, whether it ends) for parts of a piece over HELD characters; the second of parts tells the end of a section."""
        split, waiting, kind = self.splitter, "", None
        for text, last in parts:
            text, waiting = waiting + text, ""
            if kind:  # a piece goes on
                n = split.run[kind](text).end()
                ends = last or n < len(text)
                if kind == "S" and not (last and n == len(text)):  # the last blank may belong to what follows
                    n -= 1
                yield text[:n], ends
                text = text[n:]
                if ends:
                    kind = None
                else:
                    waiting = text
                    continue
            found = split.pieces(text)
            if last or not found:
                yield found
                continue
            waiting = found.pop()
            if waiting in ("r", "v", "l") and found and found[-1] == "'":  # may be one piece with the next letter
                waiting = found.pop() + waiting
            yield found
            if len(waiting) > HELD:
                kind = split.kind(waiting[-1])
                n = len(waiting) - (kind == "S")
                yield waiting[:n], False
                waiting = waiting[n:]
        if waiting or kind:
            yield (waiting, True) if kind else split.pieces(waiting)

    def _sections(self, chunks: Iterable[str]) -> Iterator[tuple[str, bool] | int]:
        """(text, whether the section ends) between special tokens, and the ids of these."""
        waiting = ""
        for chunk in chunks:
            *before, rest = self.cut(waiting + chunk)
            for k, part in enumerate(before):
                yield self.special[part] if k % 2 else (part, True)
            keep = max((n for s in self.special for n in range(1, len(s)) if rest.endswith(s[:n])), default=0)
            waiting = rest[len(rest) - keep :]
            if len(rest) > keep:
                yield rest[: len(rest) - keep], False
        yield waiting, True

    def encode(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids (little-endian unsigned 32-bit) of a text that arrives in chunks; special tokens in the text are their own ids."""
        known, out, special, more = self.known, [], None, True
        sections = self._sections(chunks)

        def section() -> Iterator[tuple[str, bool]]:
            nonlocal special, more
            for part in sections:
                if isinstance(part, int):
                    special = part
                    return
                yield part
                if part[1]:
                    special = next(sections, None)
                    more = special is not None
                    return

        def goes_on(first: str, found: Iterator) -> Iterator[bytes]:
            yield first.encode()
            for text, ends in found:
                yield text.encode()
                if ends:
                    return

        while more:
            found = self._pieces(section())
            for some in found:
                if isinstance(some, tuple):
                    for ids in self.stream(goes_on(some[0], found) if not some[1] else [some[0].encode()]):
                        yield struct.pack(f"<{len(ids)}I", *ids)
                    continue
                try:
                    yield b"".join([known[p] for p in some])
                except KeyError:
                    yield b"".join([known[p] if p in known else self.whole(p) for p in some])
            if more:
                yield struct.pack("<I", special)
        trim(known, CACHED_PIECES)

    def decoder(self) -> Callable[[bytes, bool], str]:
        """A machine from ids to text: bytes of an unfinished character are carried from one call to the next; broken ones become U+FFFD."""
        machine, get = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__
        return lambda ids, last=False: machine.decode(b"".join(map(get, np.frombuffer(ids, "<u4").tolist())), last)


def chunks_of(text: pa.StringScalar) -> Iterator[str]:
    """A text in chunks of CHUNK bytes, decoded as they are taken."""
    raw = text.as_buffer()
    if raw is None or not len(raw):
        return
    machine = codecs.getincrementaldecoder("utf-8")()
    view = memoryview(raw)
    for i in range(0, len(view), CHUNK):
        yield machine.decode(view[i : i + CHUNK])


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (binary, little-endian unsigned 32-bit). Null texts count as empty and have no ids.

    Encodes whole texts, of any length and with or without white space. Ids are numbers. Repeated rows and null ids are kept;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([b"".join(machine.encode(chunks_of(t))) for t in some.column(1)], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, text. Null ids give an empty text; broken UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([machine.decoder()(x or b"", True) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are decoded again as they are emitted, and none are kept.

    Nulls, repeated rows and empty tables as in encode_texts.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, encoded, decoded, decode = 0, hashlib.sha256(), hashlib.sha256(), machine.decoder()
                for ids in machine.encode(chunks_of(text)):
                    n += len(ids) // 4
                    encoded.update(ids)
                    decoded.update(decode(ids).encode())
                decoded.update(decode(b"", True).encode())
                rows.append((n, encoded.hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
