"""Near-duplicates by shingle sets: a join on parity sketches that loses no pair, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.components import connected_components
from wattgrid.functions.scratch import Scratch
from wattgrid.llm.words import distinct, hashed_words, mixed, rolled

WORDS, PERCENT = 5, 80
#: Classes whose keys a task has written, and members of a group that are compared at once: memory of a task.
SEEN, BLOCK = 200_000, 1024
#: Candidate pairs tried per pair of components, group and round; further rounds try the rest.
TRIED = 4


def shingle_sets(texts: list[str], seed: int = 0, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text: A-Z lower-cased, words between ASCII white space."""
    for h, _, _ in hashed_words([t.encode().lower() for t in texts]):
        yield distinct(rolled(h + np.uint64(seed), min(words, len(h)))) if len(h) else h


def shingle_set(text: str, seed: int = 0, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], seed, words))


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers, as signed ones, that depend on the whole set."""
    both = np.array([np.bitwise_xor.reduce(s), np.add.reduce(s * (s >> np.uint64(29) | np.uint64(1)))])
    both[0:1] = mixed(both[0:1] + both[1:2])
    return tuple(both.view(np.int64).tolist())


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch: bit j is the parity of the members that hash to j. It has a power of two of bits, 2 to 4 for each member and 64 at least, so that the longer of two folds onto the shorter."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of sets of sizes a and b that link: union - intersection <= (1 - t) / (1 + t) * (a + b)."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """Upper sizes of the bands in which a set of size n has keys. A pair meets in the band of its larger set: that is n's own, or that of the largest set it can link with."""
    largest, hi = 100 * n // percent, 1
    while hi < n:
        hi *= 2
    return [hi] if largest <= hi else [hi, 2 * hi]


def part_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """64-bit keys such that two sets that link share one at least.

    In each band the hashes are dealt to p parts, and a part's value is the XOR of its members: a parity sketch whose
    differing parts are at most the symmetric difference d. A set of size n can link within its band only at d or less, so
    among any d + 1 of its parts one is the same in the partner. The d + 1 parts that score highest get keys; the score,
    number of members then a hash of the value, depends on the part alone, so of a pair's agreeing parts the one above the
    higher of the two cuts has a key on both sides. Many-membered parts are the least likely to agree by chance.
    """
    n, out = len(s), []
    for hi in bands(n, percent):
        parts = most_different(hi, hi, percent) * 5 // 4 + 1
        need = most_different(n, min(hi, 100 * n // percent), percent) + 1
        part = ((s * np.uint64(2 * hi + 0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        value = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(value, part, s)
        key = mixed(value + np.arange(parts, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(hi * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        if need >= parts:
            out.append(key)
            continue
        score = count.astype(np.float64) + (mixed(key) >> np.uint64(12)) / float(1 << 52)
        cut = np.partition(score, parts - need)[parts - need]
        out.append(key[score >= cut])
    return np.concatenate(out).astype(np.int64)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, which are not null, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:-1]):
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(starts[-2]))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, leader, cid) of keys that two classes share, from rows (key, cid) sorted by both; works on whole batches."""
    tail = np.zeros((2, 0), np.int64)
    lead: tuple[int, int] | None = None  # the key that runs on, and its leader if it has one

    def out(key, cid, final):
        nonlocal tail, lead
        new = np.r_[True, (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])]
        key, cid = key[new], cid[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        leader = np.repeat(cid[start], size)
        if lead is not None and key[0] == lead[0]:
            leader[: size[0]] = lead[1]
            size[0] += 1
        keep = np.repeat(size > 1, np.diff(np.r_[start, len(key)]))
        if not final:  # a last run of one row may go on
            if size[-1] == 1:
                tail, lead = np.array([[key[-1]], [cid[-1]]]), None
            else:
                tail, lead = np.array([[key[-1]], [cid[-1]]]), (key[-1], leader[-1])
                keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, leader, cid)], names=["key", "leader", "cid"])

    for b in batches:
        if b.num_rows:
            key, cid = np.r_[tail[0], b.column(0).to_numpy()], np.r_[tail[1], b.column(1).to_numpy()]
            yield from out(key, cid, False)
    if tail.shape[1]:
        yield from out(tail[0], tail[1], True)


def _unpacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches folded to the shortest, as rows of 64-bit words."""
    least = min(map(len, sketches)) // 8
    out = np.zeros((len(sketches), least), np.uint64)
    for i, b in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, least), axis=0)
    return out


def far_apart(a: tuple[int, bytes], b: tuple[int, bytes], percent: int = PERCENT) -> bool:
    """Whether sizes or sketches show that two sets don't link."""
    if 100 * min(a[0], b[0]) < percent * max(a[0], b[0]):
        return True
    x = _unpacked([a[1], b[1]])
    return int(np.bitwise_count(x[0] ^ x[1]).sum()) > most_different(a[0], b[0], percent)


def _close_pairs(batches: Iterator[pa.RecordBatch], percent: int, tried: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a group, of different components, that sizes and sketches allow; the closest of each two components."""
    for g in groups_of(batches, 3):
        side, cid, comp, n = (g.column(i).to_numpy() for i in range(3, 7))
        if len(cid) < 2 or comp.min() == comp.max():
            continue
        sketches = g.column(7).to_pylist()
        lengths = np.array([len(x) for x in sketches])
        same_block = g.column(1)[0].as_py() == g.column(2)[0].as_py()
        left_all, right_all = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if same_block:
            right_all = left_all
        found: list[tuple[int, int, int]] = []
        for size in np.unique(lengths):  # the shorter sketch of a pair has this length
            for la, lb in ((size, size), (size, 2 * size), (2 * size, size)):
                left, right = left_all[lengths[left_all] == la], right_all[lengths[right_all] == lb]
                if not len(left) or not len(right) or (same_block and la > lb):
                    continue
                w = int(min(la, lb)) // 8
                fold = lambda rows: np.array([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, w), axis=0) for i in rows])  # noqa: E731, B023
                x, y = fold(left), fold(right)
                step = max(1, 2_000_000 // (len(right) * w))
                for a in range(0, len(left), step):
                    rows = left[a : a + step]
                    apart = np.zeros((len(rows), len(right)), np.int64)
                    for k in range(w):
                        apart += np.bitwise_count(x[a : a + step, k, None] ^ y[None, :, k])
                    total = n[rows][:, None] + n[right][None, :]
                    small = np.minimum(n[rows][:, None], n[right][None, :])
                    ok = (apart <= (100 - percent) * total // (100 + percent)) & (comp[rows][:, None] != comp[right][None, :]) & (100 * small >= percent * (total - small))
                    if same_block and la == lb:
                        ok &= cid[rows][:, None] < cid[right][None, :]
                    i, j = np.nonzero(ok)
                    found += zip(apart[i, j].tolist(), rows[i].tolist(), right[j].tolist())
        if not found:
            continue
        taken: dict[tuple[int, int], int] = {}
        out = []
        for _, i, j in sorted(found):
            pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
            taken[pair] = taken.get(pair, 0) + 1
            if taken[pair] <= tried:
                out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
        a, b = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([len(found) > len(out)] * len(out), pa.bool_())], names=["a", "b", "cut"])


class _Join:
    """The steps of near_duplicates over tables in a scratch folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.scratch = Scratch(docs.sparkSession, "near-dups")
        self.rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        self.words, self.percent, self.seed = words, percent, 0
        self.n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def identified(self) -> DataFrame:
        words, seed = self.words, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    some, out = b.slice(i, 1000), []
                    for s in shingle_sets(some.column(1).to_pylist(), seed, words):
                        out.append((len(s), *(set_identity(s) if len(s) else (0, 0)), sketch(s) if len(s) else b""))
                    n, k1, k2, sk = zip(*out)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "n", "cid", "k2", "sketch"])

        return self.rows.mapInArrow(run, "doc_id bigint, n bigint, cid bigint, k2 bigint, sketch binary")

    def meetings(self) -> DataFrame:
        """(key, leader, cid): classes that share a key; the leader is the smallest of them."""
        words, seed, percent = self.words, self.seed, self.percent

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    some, key, cid = b.slice(i, 500), [], []
                    for s in shingle_sets(some.column(0).to_pylist(), seed, words):
                        if not len(s):
                            continue
                        own = set_identity(s)
                        if own in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(own)
                        key.append(part_keys(s, percent))
                        cid.append(np.full(len(key[-1]), own[0], np.int64))
                    if key:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(cid))], names=["key", "cid"])

        entries = self.rows.select("text").mapInArrow(keys, "key bigint, cid bigint")
        return entries.repartition(self.n, "key").sortWithinPartitions("key", "cid").mapInArrow(_meetings, "key bigint, leader bigint, cid bigint")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that link by their whole shingle sets."""
        words, seed, percent = self.words, self.seed, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, x = None, None
            for b in batches:
                out = []
                for a, c, t, y in zip(*[b.column(i).to_pylist() for i in range(3)], shingle_sets(b.column(3).to_pylist(), seed, words)):
                    if a != last:
                        last, x = a, shingle_set(t, seed, words)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, c))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

        one = texts.select(F.col("cid").alias("a"), F.col("text").alias("t"))
        two = texts.select(F.col("cid").alias("b"), F.col("text").alias("u"))
        return pairs.join(two, "b").join(one, "a").select("a", "b", "t", "u").mapInArrow(run, "a bigint, b bigint")

    def texts_of(self, members: DataFrame, known: DataFrame) -> DataFrame:
        """(cid, text), one row for each class in members (cid, rep); known: doc_id and cid of all rows, as a class may have many rows of one id."""
        words, seed = self.words, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # an id may have several texts
                keep = [len(s) > 0 and c == set_identity(s)[0] for c, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), seed, words))]
                yield b.filter(pa.array(keep, pa.bool_()))

        rows = self.rows.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").select("cid", "text")
        found = rows.mapInArrow(run, "cid bigint, text string")
        many = self.scratch.cut(members.join(known.groupBy("doc_id", "cid").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("doc_id", "rep"), ["cid", "rep"]).select("cid"))
        if many.isEmpty():
            return self.scratch.cut(found)
        found = self.scratch.cut(found)
        return self.scratch.cut(found.join(many, "cid", "left_anti").union(found.join(many, "cid", "left_semi").groupBy("cid").agg(F.min("text").alias("text"))))

    def components(self, links: DataFrame) -> DataFrame:
        """(cid, comp) for every class on a link; comp is a class."""
        return self.scratch.cut(connected_components(links, self.scratch).select(F.col("id").alias("cid"), F.col("component_id").alias("comp")))

    def open_pairs(self, met: DataFrame, parts: DataFrame, size: DataFrame, tried: int) -> DataFrame:
        """(a, b, cut): pairs of different components, both not their group's leader, that share a key and that sizes and sketches allow.

        ``tried`` of each two components, group and block are given (all for 0), with cut where there are more. Of groups with
        the same members one is compared.
        """
        percent = self.percent
        rows = met.where("cid <> leader").select("key", "cid").join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        groups = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("cid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("h2"))
        groups = groups.where("lo < hi").groupBy("h1", "h2", "members").agg(F.min("key").alias("key"))
        rows = rows.join(groups.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "key")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        rows = rows.select("key", "cid", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "comp")
        rows = rows.join(size, "cid").select("key", "i", "j", "side", "cid", "comp", "n", "sketch")
        rows = rows.repartition(self.n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")
        return rows.mapInArrow(lambda b: _close_pairs(b, percent, tried or 1 << 60), "a bigint, b bigint, cut boolean")


def _allowed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, sa, nb, sb = (b.column(x).to_pylist() for x in ("na", "sa", "nb", "sb"))
            keep = [not far_apart((na[i], sa[i]), (nb[i], sb[i]), percent) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``words`` words (all words as one if there are fewer; A-Z lower-cased;
    words between ASCII white space). Two documents link when 100 * intersection >= percent * union. component_id is the
    smallest id that links reach. Shingles are told apart by 64-bit hashes: two texts of 1,000 shingles each hold two different
    ones with equal hashes with a chance of 5e-14, and that matters only to a pair that a single shingle decides.

    Documents with equal sets form a class, and classes are compared. Classes that share a key of their parity sketch
    are candidates; each is first verified against one leader, then groups that still hold several components are compared
    by whole sketches, in blocks, and pairs between components that the sketches allow are verified by their sets,
    round by round, until none is left. So no link between components is lost, and pairs within a component are not listed.

    Ids are numbers. Null and empty texts have 0 shingles and link with nothing. Rows with a null id link with nothing and have a null
    component_id. Rows that share an id are one node, with the links of each of its texts. Other columns are ignored; an
    empty table gives an empty result.
    """
    j = _Join(docs, id_col, text_col, words, percent)
    scratch = j.scratch
    while True:
        known = scratch.cut(j.identified())
        classes = known.where("n > 0 and doc_id is not null").groupBy("cid", "n", "k2").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
        classes = scratch.cut(classes)
        if classes.count() == classes.select("cid").distinct().count():
            break
        scratch.drop(known, classes)
        j.seed += 1
    met = scratch.cut(j.meetings())
    texts = j.texts_of(met.select("cid").distinct().join(classes.select("cid", "rep"), "cid"), known.select("doc_id", "cid"))
    size = classes.select("cid", "n", "sketch")
    firsts = known.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("doc_id", "a")
    same_id = known.where("n > 0").join(firsts, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b"))

    star = met.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    star = star.join(size.toDF("a", "na", "sa"), "a").join(size.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "sa", "nb", "sb")
    star = scratch.cut(star.mapInArrow(_allowed(percent), "a bigint, b bigint"))
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.cut(j.verified(first, texts).union(same_id))
    parts = j.components(links)
    rest = star.join(first, ["a", "b"], "left_anti")
    for limit in (None, TRIED, 0):
        if limit is None:
            pairs = rest
        else:
            opened = scratch.cut(j.open_pairs(met, parts, size, limit))
            pairs = opened.select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
        sides = parts.toDF("a", "ca"), parts.toDF("b", "cb")
        pairs = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        pairs = scratch.cut(pairs)
        more = None if pairs.isEmpty() else scratch.cut(j.verified(pairs, texts))
        if more is not None and not more.isEmpty():
            links = scratch.cut(links.union(more))
            parts = j.components(links)
        if limit and opened.where("cut").isEmpty():
            break
    reps = classes.join(parts, "cid", "left").select("cid", "rep", F.coalesce("comp", "cid").alias("comp"))
    least = reps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    answer = scratch.cut(reps.join(least, "comp").select("cid", "component_id"))
    scratch.keep_only(known, answer)
    scratch.sweep()
    rows = known.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("cid")).alias("cid"))
    return rows.join(answer, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
