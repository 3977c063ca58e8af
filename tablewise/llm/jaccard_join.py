"""Jaccard join of word n-gram sets by vertical partitioning.

The n-grams have one global order, that of their 64-bit hashes, and the order is cut into fragments. A set's part in a
fragment is compared with other sets' parts in the same fragment only.

*Candidates.* Sets whose similarity reaches the threshold differ in a bounded number of n-grams, D. With the order cut into
more than D fragments, some fragment has equal parts. So a set sends a hash of each of its parts, and sets that
share one are candidates. Sets of similar size use the same cut; a set near the end of its size class uses that of the next too.
Parts that are empty in both sets prove nothing: a cut has spare fragments for them, and a set with more
empty parts than that uses the cut of another order too, and so on until it has few. Of two similar sets the one that stops first
has few empty parts in a cut that both use, so no pair is lost.

n-grams that many texts have (shared passages, frequent phrases) make unlike sets candidates, ever more of them as the corpus grows. They are found by counting in a
part of the texts, and a set with enough other n-grams sends parts of these only: that leaves out the same n-grams of every set, so no more
n-grams of two sets differ than before. A set with few others sends parts of all its n-grams; one in between sends both.

The sets of a key are held against each other by the counts below, pair by pair, if they are few; of more sets each is connected with the first.

*Overlaps.* Candidates are connected to groups, and the pairs of a group are held against the threshold twice. First by counts: for each fragment a set has the number
of its n-grams there, two sets share no more of a fragment than the smaller number, and the sum of these partial overlaps over the fragments bounds the whole. Pairs
that the bound allows form new, smaller groups, and only their texts are sent: in each fragment the partial overlaps of all pairs
of a block are counted by one product of membership matrices, and summed over the fragments.
Groups larger than a block are split: every block meets some pivots of its group first, then each pair of blocks that don't already belong to one
component meets. What leaves a task is a forest of links, never the pairs.

Copies (equal sets) are one vertex from the start, named by a hash of the set; hashes of 64 bits stand for n-grams and sets throughout.

Results in odd cases: texts that are null or without words have size 0 and stand alone; texts with fewer words than an n-gram
have one n-gram, their whole sequence; rows that repeat a ``doc_id`` and its text are copies, unlike texts of one ``doc_id`` (or without one) are sets of their own; a null ``doc_id`` counts as the smallest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.arrays import Texts, mix, span_hashes, texts, window_hashes, word_hashes
from tablewise.llm.components import components
from tablewise.llm.shared import given, number, one_row_each, tasks, text_key, written

#: Sets and n-grams that meet in a block.
BLOCK_SETS = 1000
BLOCK_GRAMS = 1_000_000
#: Sets whose counts by fragment meet in a block.
BLOCK_COUNTS = 2000
#: Entries of a membership matrix.
MATRIX = 16_000_000
#: About as many sets of a large group meet every block of it.
PIVOTS = 8
#: Texts in which frequent n-grams are looked for: so many, or that share of all. An n-gram in ``COMMON_IN`` of them is frequent; at most ``COMMON`` n-grams are.
COMMON_TEXTS = 20_000
COMMON_SHARE = 1 / 16
COMMON_IN = 4
COMMON = 1 << 20
#: Sets of a key that are held against each other in pairs.
PAIRED = 32
#: n-grams that a task counts at once.
COUNTED = 4_000_000
_ROWS = "key long, vertex long, other long"
_LINKS = "a long, b long"


def gram_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text (A-Z in lower case), and where each text's begin."""
    words = word_hashes(t, lower=True)
    counts = np.diff(t.words)
    grams = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(len(t)), grams)
    start = np.arange(offsets[-1]) - offsets[:-1][doc] + t.words[:-1][doc]
    whole = window_hashes(words, size)
    values = np.empty(offsets[-1], np.uint64)
    long = counts[doc] >= size
    values[long] = whole[start[long]]
    if not long.all():
        values[~long] = span_hashes(words, start[~long], start[~long] + counts[doc[~long]], 0xA0761D6478BD642F)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo > 1:
            values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]], 0 if empty, modulo 2 ** 64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def vertices(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(_sums(mix(values ^ np.uint64(0x2545F4914F6CDD1D)), offsets) + np.diff(offsets).astype(np.uint64))


@lru_cache(maxsize=8)
def cuts(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each class of sizes, its number of fragments (0: only equal sets are similar), and the empty parts it allows.

    A class ends before 1.5 times its first size, or den / num times if that is more: a similar set is in the same or the next class.
    The parts are the fewest of which a set is rarely emptier than allowed, or as near to that as small sets come.
    """
    if 4 * num < 3 * den:
        raise ValueError("the threshold must be 0.75 or more")
    first, fragments, spare = [1], [], []
    while first[-1] < 1 << 40:
        low = first[-1]
        high = max(low + 1, -(-low * max(3 * num, 2 * den) // (2 * num)))
        differ = 2 * (high - 1) * (den - num) // (den + num)
        n = np.unique(np.linspace(differ + 1, 3 * differ + 6, 200).astype(np.int64))
        empty = n * np.exp(-(-(-low * num // den)) / n)  # of the smallest set that uses the cut, one of the class before
        ease = np.minimum((n - differ - 1 - empty) / np.sqrt(empty + 1e-12), 2)
        n = int(n[ease.argmax()]) if differ else 0
        fragments.append(n)
        spare.append(n - differ - 1)
        first.append(high)
    return np.array(first[:-1]), np.array(fragments), np.array(spare)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    head = np.zeros(1 << 22, bool)
    head[some >> np.uint64(42)] = True
    out = head[values >> np.uint64(42)]
    at = np.flatnonzero(out)
    out[at] = some[np.minimum(np.searchsorted(some, values[at]), len(some) - 1)] == values[at]
    return out


def keys(values: np.ndarray, offsets: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A key of each part of each set that can have similar sets, and the set's index; sets with enough n-grams that are not ``common`` (sorted) have keys of these."""
    first, fragments, spare = cuts(num, den)
    size = np.diff(offsets)
    own = np.searchsorted(first, size, "right") - 1
    found_keys, found_sets = [], []
    rare = np.zeros(0, bool) if common is None else ~among(values, common)
    rest = np.concatenate([[0], np.cumsum(rare)])[offsets] if common is not None else offsets
    rare_values = values[rare] if common is not None else values
    # as many as leave no more parts empty than are allowed
    enough = np.ceil(fragments * np.log(np.maximum(fragments, 1) / np.maximum(spare, 0.5)))
    for up, some in ((0, False), (1, False)) if common is None else ((0, False), (0, True), (1, False), (1, True)):
        level = own + up
        near = (size > 0) & (fragments[level] > 0)
        if up:  # a set of the next class may be similar: its size is at least first[level], and at most size * den / num
            near &= size * den >= first[level] * num
        if common is not None:  # a similar set lacks at most size * (den - num) / den of a set's n-grams: if this one has keys of rare n-grams only, that one has such keys too
            near &= np.diff(rest) >= enough[level] if some else np.diff(rest) < enough[level] + size * (den - num) // den
        of_values, of_offsets = (rare_values, rest) if some else (values, offsets)
        which, turn = np.flatnonzero(near), 0
        while len(which):
            n = np.diff(of_offsets)[which]
            own_values = of_values[np.repeat(of_offsets[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ordered = mix(own_values + np.uint64(turn * 0x9E3779B9)) if turn else own_values
            at = np.repeat(np.arange(len(which)), n)
            part = ((ordered >> np.uint64(32)) * fragments[level[which]][at].astype(np.uint64)) >> np.uint64(32)
            if turn:
                order = np.lexsort((part, at))
                part, own_values = part[order], own_values[order]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (at[1:] != at[:-1])
            begin = np.flatnonzero(new)
            sums = _sums(mix(own_values), np.append(begin, len(part)))
            cut = (np.uint64(some) << np.uint64(60)) + (level[which][at[begin]].astype(np.uint64) << np.uint64(48)) + (np.uint64(turn) << np.uint64(40)) + part[begin]
            found_keys.append(mix(sums ^ mix(cut)))
            found_sets.append(which[at[begin]])
            filled = np.bincount(at[begin], minlength=len(which))
            which = which[fragments[level[which]] - filled > spare[level[which]]]
            turn += 1
    if not found_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found_keys), np.concatenate(found_sets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def histograms(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many n-grams of each set fall into each fragment of the order; a set has a power of two of fragments, about a fourth of its size."""
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        bits = min(12, max(4, (hi - lo).bit_length() - 2))
        counts = np.bincount((values[lo:hi] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        width = 1 if counts.max() < 256 else 4
        out.append(bytes([width]) + counts.astype(f"<u{width}").tobytes())
    return out


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int32)


def sized(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``own``, ``n_shingles``, ``vertex`` (the name of its set) and ``counts`` (of its n-grams by fragment) of every row of ``docs(doc_id, text, own)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                values, offsets = gram_sets(t, size)
                numbers, own = (b.column(i).slice(t.first, len(t)) for i in (0, 2))
                yield pa.record_batch([numbers, own, pa.array(np.diff(offsets)), _signed(vertices(values, offsets)), pa.array(histograms(values, offsets), pa.binary())], ["doc_id", "own", "n_shingles", "vertex", "counts"])

    return docs.mapInArrow(of, "doc_id long, own long, n_shingles long, vertex long, counts binary")


def common_grams(docs: DataFrame, size: int, rows: int) -> np.ndarray | None:
    """Sorted n-grams that are in many of some texts, drawn by their hash; none of a small table. Which ones are found changes no result."""
    if rows <= COMMON_TEXTS:
        return None
    share = max(COMMON_SHARE, COMMON_TEXTS / rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.record_batch([_signed(gram), pa.array(n)], ["gram", "n"])

        for b in batches:
            for t in texts(b.column(0)):
                waiting.append(gram_sets(t, size)[0])
                if sum(map(len, waiting)) > COUNTED:
                    yield counted()
        if waiting:
            yield counted()

    some = docs.where(F.pmod(F.xxhash64("own", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    found = some.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_IN)
    found = written(found, "common")
    least, held = COMMON_IN, 0
    for r in found.groupBy("n").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("n")).collect():  # a row for each number of texts, the greatest first
        held += r["grams"]
        if held > COMMON:
            least = r["n"] + 1
            break
    grams = found.where(F.col("n") >= least).select("gram").toArrow().column("gram").to_numpy()  # bounded by COMMON
    return np.sort(grams.view(np.uint64))


def candidates(docs: DataFrame, size: int, num: int, den: int, common: np.ndarray | None = None) -> DataFrame:
    """Edges ``a``, ``b`` of vertices with an equal part in some fragment: where ``sure`` is false all pairs of them, else a star that connects them."""
    sent_common = None if common is None else docs.sparkSession.sparkContext.broadcast(common)  # bounded by COMMON

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if sent_common is None else sent_common.value
        for b in batches:
            for t in texts(b.column(1)):
                values, offsets = gram_sets(t, size)
                names = vertices(values, offsets)
                names, one = np.unique(names, return_index=True)
                own = np.diff(offsets)[one]
                values = values[np.repeat(offsets[one] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
                key, of_set = keys(values, np.concatenate([[0], np.cumsum(own)]), num, den, frequent)
                if not len(key):
                    continue
                # of many sets here with one key the first goes on alone, marked by itself, with an edge from each other one to it
                order = np.lexsort((of_set, key))
                key, name = key[order], names[of_set[order]]
                first, count, lead = _runs(key)
                many, new = count > PAIRED, np.arange(len(key)) == lead
                on = new | ~many
                yield pa.record_batch([_signed(key[on]), _signed(name[on]), pa.array(name[on].view(np.int64), mask=~many[on])], ["key", "vertex", "other"])
                edges = np.unique(np.stack([name[~on], name[lead][~on]], axis=1), axis=0)
                edges = edges[edges[:, 0] != edges[:, 1]]
                if len(edges):
                    yield pa.record_batch([_signed(mix(edges[:, 0] ^ edges[:, 1])), _signed(edges[:, 0]), _signed(edges[:, 1])], ["key", "vertex", "other"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # key, vertex and mark of the key that is open

        def rows(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])

        def found(key: np.ndarray, name: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
            first, count, lead = _runs(key)
            many = count > PAIRED
            many |= np.logical_or.reduceat(mark, first)[np.cumsum(np.arange(len(key)) == lead) - 1]
            star = many & (name != name[lead])
            if star.any():
                yield rows(name[star], name[lead][star], True)
            on = (count > 1) & ~many
            key, name = key[on], name[on]
            a, b = [], []
            for step in range(1, min(PAIRED, len(key))):
                at = np.flatnonzero(key[step:] == key[:-step])
                if not len(at):
                    break
                a.append(name[at])
                b.append(name[at + step])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                keep = a != b
                keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield rows(a[keep], b[keep], False)

        for batch in batches:
            valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, vertex, other = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            mark = valid & (vertex == other)
            edge = valid & ~mark
            if edge.any():
                yield rows(vertex[edge], other[edge], True)
            key, name, mark = (np.concatenate([h, x[~edge]]) for h, x in zip(held, (key, vertex, mark), strict=True))
            if not len(key):
                continue
            open_ = int(np.searchsorted(key, key[-1]))
            if open_:
                yield from found(key[:open_], name[:open_], mark[:open_])
            key, name, mark = key[open_:], name[open_:], mark[open_:]
            if len(key) > PAIRED:  # of many sets only the first is held, with its mark
                yield from found(key, name, np.ones(len(key), bool))
                key, name, mark = key[:1], name[:1], np.ones(1, bool)
            held = (key, name, mark)
        if len(held[0]):
            yield from found(*held)

    sent = docs.mapInArrow(send, _ROWS)
    return sent.repartition(tasks(docs), "key").sortWithinPartitions("key").mapInArrow(meet, _LINKS + ", sure boolean").distinct()


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each run begins, and for every place the length and the begin of its run."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    return first, np.repeat(count, count), np.repeat(first, count)


def held_by_counts(edges: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b`` of the edges that are ``sure`` or that the counts by fragment allow."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one, other = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            kind = np.array([[len(x), x[0], len(y), y[0]] for x, y in zip(one, other, strict=True)])
            _, of_kind = np.unique(kind, axis=0, return_inverse=True)
            common = np.zeros(batch.num_rows, np.int64)
            for k in range(of_kind.max() + 1):
                at = np.flatnonzero(of_kind == k)
                x, y = (np.stack([_counts(blobs[i]) for i in at]) for blobs in (one, other))
                few = min(x.shape[1], y.shape[1])
                common[at] = np.minimum(x.reshape(len(at), few, -1).sum(axis=2), y.reshape(len(at), few, -1).sum(axis=2)).sum(axis=1)
            keep = pa.array(common.astype(np.float64) * (den + num) >= num * (n + m))
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    pairs = edges.where("NOT sure").select("a", "b")
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("vertex").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")).hint("merge"), x)
    near = pairs.where((F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num))
    held = near.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(of, _LINKS)
    return edges.where("sure").select("a", "b").unionByName(held)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each pair of sets: partial counts of each fragment of the order, summed."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram) > 1
    column = (np.cumsum(shared) - 1)[gram]
    on = shared[gram]
    column, owner = column[on], owner[on]
    total = np.zeros((m, m), np.float32)
    width = max(1, MATRIX // m)
    for low in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [low, low + width])
        part = np.zeros((m, min(width, int(shared.sum()) - low)), np.float32)
        part[owner[lo:hi], column[lo:hi] - low] = 1
        total += part @ part.T
    return total.astype(np.int64)


def most_in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """No set of ``a`` and set of ``b`` can have more n-grams in common: in a fragment as many as the one with fewer has there, summed over the fragments.

    Sets with different numbers of fragments are compared in the fewer, of which each is several of the other. The smaller of two counts is the number of thresholds that both reach,
    so small counts are summed by products of 0/1 matrices.
    """
    total = np.zeros((len(a), len(b)))
    wide_a, wide_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for na in np.unique(wide_a):
        for nb in np.unique(wide_b):
            at, bt, few = np.flatnonzero(wide_a == na), np.flatnonzero(wide_b == nb), min(na, nb)
            x = np.stack([a[i] for i in at]).reshape(len(at), few, -1).sum(axis=2)
            y = np.stack([b[i] for i in bt]).reshape(len(bt), few, -1).sum(axis=2)
            most = int(min(x.max(), y.max()))
            if most <= 64:
                part = np.zeros((len(at), len(bt)), np.float32)
                for t in range(1, most + 1):
                    part += (x >= t).astype(np.float32) @ (y >= t).astype(np.float32).T
            else:
                part = np.stack([np.minimum(r, y).sum(axis=1) for r in x])
            total[np.ix_(at, bt)] = part
    return total


def allowed(common: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of the sizes ``a`` and ``b`` with so many n-grams in common reach the threshold."""
    return common.astype(np.float64) * (den + num) >= num * (a[:, None] + b[None, :])


def links(names: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links with the components of all links between the sets."""
    np.fill_diagonal(linked, False)
    root = np.full(len(names), -1)
    a, b = [], []
    for i in range(len(names)):
        if root[i] < 0:
            root[i], queue = i, [i]
            while queue:
                x = queue.pop()
                for y in np.flatnonzero(linked[x] & (root < 0)).tolist():
                    root[y] = i
                    queue.append(y)
                    a.append(x)
                    b.append(y)
    return names[a], names[b]


def _compared(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links among the texts of each ``unit`` of ``rows(unit, vertex, text)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, sets = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if len(names) > 1:
                size = np.array([len(s) for s in sets])
                a, b = links(np.array(names), allowed(overlaps(sets), size, size, num, den))
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            units, vertex = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for t in texts(batch.column(2)):
                values, offsets = gram_sets(t, size)
                for i in range(len(t)):
                    row = t.first + i
                    if units[row] != unit:
                        yield from found()
                        unit, names, sets = units[row], [], []
                    if not names or names[-1] != vertex[row]:
                        names.append(vertex[row])
                        sets.append(values[offsets[i] : offsets[i + 1]].copy())
        yield from found()

    return rows.repartition(tasks(rows), "unit").sortWithinPartitions("unit", "vertex").mapInArrow(of, _LINKS)


def _texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Texts of the rows in ``placed``, which grows with the corpus: a merge join at every size, never a broadcast."""
    return docs.join(placed.hint("merge"), ["doc_id", "own"])


def _possible(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links that the counts by fragment allow among the sets of each ``unit`` of ``rows(unit, block, vertex, n, counts)``: between its two blocks, or in its only one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, blocks = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            sides = [tuple(map(list, zip(*x, strict=True))) for x in blocks.values()]
            if not sides or len(sides) == 1 and len(sides[0][0]) < 2:
                return
            (a, size_a, counts_a), (b, size_b, counts_b) = sides[0], sides[-1]
            linked = allowed(most_in_common(counts_a, counts_b), np.array(size_a), np.array(size_b), num, den)
            names = a
            if len(sides) == 2:
                names, cross = a + b, linked
                linked = np.zeros((len(names), len(names)), bool)
                linked[: len(a), len(a) :], linked[len(a) :, : len(a)] = cross, cross.T
            one, other = links(np.array(names), linked)
            if len(one):
                yield pa.record_batch([pa.array(one), pa.array(other)], ["a", "b"])

        for batch in batches:
            for u, block, vertex, n, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if u != unit:
                    yield from found()
                    unit, blocks = u, {}
                side = blocks.setdefault(block, [])
                if not side or side[-1][0] != vertex:
                    side.append((vertex, n, _counts(blob)))
        yield from found()

    rows = rows.select("unit", F.col("block").cast("long").alias("block"), "vertex", "n", "counts")
    return rows.repartition(tasks(rows), "unit").sortWithinPartitions("unit", "block", "vertex").mapInArrow(of, _LINKS)


def _met(edges: DataFrame, classes: DataFrame, compared, num: int, den: int, sets: int, grams: int | None = None) -> DataFrame:
    """Links that ``compared`` finds between the sets of each component of ``edges``, in blocks of so many sets and n-grams; as a written table."""
    groups = written(components(edges).select(F.col("node").alias("vertex"), F.col("root").alias("group")).join(classes, "vertex"), "groups")
    cuts_ = lambda n, size: F.greatest(F.ceil(n / sets), F.ceil(size / grams) if grams else F.lit(1))
    totals = groups.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    totals = totals.withColumn("blocks", cuts_(F.col("sets"), F.col("grams")).cast("int")).where("sets > 1")
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("vertex", F.lit(1)), F.ceil(F.col("sets") / PIVOTS)) == 0)
    placed = groups.join(totals, "group").withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    found = written(compared(placed.withColumn("unit", F.xxhash64("group", "block"))), "links")
    large = groups.join(totals.where("blocks > 1").select("group"), "group")
    if large.isEmpty():
        return found
    return found.unionByName(written(compared(_across(large, found, cuts_, num, den)), "links"))


def _across(large: DataFrame, found: DataFrame, cuts_, num: int, den: int) -> DataFrame:
    """Rows of the pairs of blocks of large groups, with their ``unit``.

    A block has sets of one band of sizes, each band up to ``den / num`` times as large as the one before, and of sets that are already connected, where there are
    enough of them; two blocks meet unless their sizes are too far apart for any link, or both are of one component.
    """
    band = F.floor(F.log("n") / math.log(den / num) + 1e-9).cast("int") if num < den else F.col("n")
    roots = components(found).withColumnRenamed("node", "vertex")
    rows = large.join(roots, "vertex", "left").withColumns({"root": F.coalesce("root", "vertex"), "band": band})
    count = [F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams")]
    one = rows.groupBy("group", "band", "root").agg(*count).withColumn("cuts", cuts_(F.col("sets"), F.col("grams")))
    alone = one.where(cuts_(F.col("sets") * 2, F.col("grams") * 2) > 1).select("group", "band", "root", F.col("cuts").alias("own_cuts"))
    rows = rows.join(alone, ["group", "band", "root"], "left")
    others = rows.where("own_cuts IS NULL").groupBy("group", "band").agg(*count).select("group", "band", cuts_(F.col("sets"), F.col("grams")).alias("cuts"))
    rows = rows.join(others, ["group", "band"], "left").withColumn("one", F.when(F.col("own_cuts").isNotNull(), F.col("root")))
    rows = rows.withColumn("block", F.when(F.col("own_cuts").isNotNull(), F.xxhash64("root", "band", F.pmod(F.xxhash64("vertex"), F.col("own_cuts")))).otherwise(F.xxhash64("group", "band", F.pmod(F.xxhash64("root"), F.col("cuts")))))
    rows = written(rows.drop("root", "band", "own_cuts", "cuts"), "blocks")
    blocks = rows.groupBy("group", "block").agg(F.first("one").alias("one"), F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("group", *[F.col(c).alias(f"{c}_b") for c in ("block", "one", "low", "high")])
    pairs = blocks.join(other, "group").where("block < block_b OR (block = block_b AND one IS NULL)").where("one IS NULL OR one_b IS NULL OR one <> one_b")
    pairs = pairs.where((F.col("high") * den >= F.col("low_b") * num) & (F.col("high_b") * den >= F.col("low") * num))
    pairs = pairs.select("group", F.xxhash64("block", "block_b").alias("unit"), F.explode(F.array_distinct(F.array("block", "block_b"))).alias("block"))
    return rows.join(pairs, ["group", "block"])


def _connected(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``doc_id``, ``own``, ``n_shingles``, ``component_id`` and ``keep_own`` of every row: the last two name the row of its component that stays."""
    docs = docs.select(number().alias("doc_id"), "text", text_key().alias("own"))
    members = written(sized(docs, size), "sets")
    least = F.min(F.struct("doc_id", "own")).alias("least")
    classes = members.where("n_shingles > 0").groupBy("vertex").agg(least, F.first("n_shingles").alias("n"), F.first("counts").alias("counts")).select("vertex", "least.*", "n", "counts")
    common = common_grams(docs, size, members.count())
    edges = written(candidates(docs, size, num, den, common), "candidates")
    edges = written(held_by_counts(edges, classes, num, den), "candidates")
    possible = _met(edges, classes, lambda rows: _possible(rows, num, den), num, den, BLOCK_COUNTS)
    by_text = lambda rows: _compared(_texts(docs, rows.select("doc_id", "own", "vertex", "unit")).select("unit", "vertex", "text"), size, num, den)
    found = _met(possible, classes.drop("counts"), by_text, num, den, BLOCK_SETS, BLOCK_GRAMS)
    roots = components(found)
    named = classes.select("vertex", "doc_id", "own").join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    least = named.groupBy("root").agg(least)
    named = named.join(least, "root").select("vertex", F.col("least.doc_id").alias("component_id"), F.col("least.own").alias("keep_own"))
    members = members.drop("counts")
    alone = members.where("n_shingles = 0").select("doc_id", "own", "n_shingles", F.col("doc_id").alias("component_id"), F.col("own").alias("keep_own"))
    return members.where("n_shingles > 0").join(named, "vertex").select(alone.columns).unionByName(alone)


def similar(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs(doc_id, text)``.

    Texts link when the Jaccard similarity of their sets of ``size``-word n-grams is ``num / den`` or more; ``component_id``
    is the smallest ``doc_id`` that links lead to.
    """
    return _connected(docs, size, num, den).select(given(), "n_shingles", given("component_id"))


def without_similar(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Exactly one row of each component, with all its columns: one with the smallest ``doc_id``, of several the one with the smallest text key, then columns.

    Rows whose text has no words stand alone and all stay.
    """
    first = _connected(docs, size, num, den).where("doc_id = component_id AND own = keep_own")
    stay = first.groupBy(F.col("doc_id").alias("_stay"), F.col("own").alias("_text")).agg(F.max(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("_words"), F.count(F.lit(1)).alias("_rows"))
    return one_row_each(docs, written(stay.select("_stay", "_text", F.when(F.col("_words") > 0, F.col("_rows")).otherwise(1).alias("_rows")), "kept"))
