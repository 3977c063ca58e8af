"""Token ids in word-aligned binary blocks (Simple-8b) and their vectorised reading.

An image holds the ids of consecutive documents: a header, the documents' numbers and lengths, the first word of every
block, and the words. A block has ``BLOCK`` ids, the last one fewer, and starts at a word. The top four bits of a word are its
selector: selectors 1 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 60 // count bits, lowest first; selector 15
is an escape: the next word is one id of up to 64 bits as it is. All numbers are little-endian.

Images are rows of a Parquet table, so Spark's own committer writes and reads them in any store and a lost executor
leaves no half-written file. A row has some ``IMAGE_IDS`` ids (a longer document makes a longer one). File and place number the images
in ascending ``doc_id`` order.

Results in odd cases: null counts as empty text, which has the end id only; rows that repeat a ``doc_id`` are
written one after the other, ordered by text; a null ``doc_id`` counts as the smallest; an empty table gives an empty file. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import given, number, tasks
from tablewise.llm.tokens import encoded

BLOCK = 1024
IMAGE_IDS = 1 << 20
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQQQQ")  # magic, ids of a block, documents, ids, blocks, words
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)  # by selector
ESCAPE = 15
WIDTHS = np.array([0, *(60 // c for c in COUNTS[1:15].tolist()), 64], np.int64)
_IMAGES = "file int, place int, n_ids long, image binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block, of 64-bit ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    # the narrowest selector that holds each id; zeros behind the end of a block fit any selector
    limits = np.array([(1 << w) - 1 for w in WIDTHS[1:15].tolist()], np.uint64)
    need = np.searchsorted(limits, padded).astype(np.uint8).reshape(blocks, BLOCK) + 1
    need[-1, n - (blocks - 1) * BLOCK :] = 1
    widest = {1: need}
    for a in range(2, int(COUNTS.max()) + 1):
        if a in COUNTS:  # the widest of a ids from two shorter runs
            b = max(x for x in widest if 2 * x >= a)
            shifted = np.ones_like(need)
            shifted[:, : BLOCK - (a - b)] = widest[b][:, a - b :]
            widest[a] = np.maximum(widest[b], shifted)
    selector = np.full(need.shape, ESCAPE, np.uint8)
    for s in range(14, 0, -1):
        selector[widest[int(COUNTS[s])] <= s] = s
    step = COUNTS[selector]
    end = np.full(blocks, BLOCK, np.int64)
    end[-1] = n - (blocks - 1) * BLOCK
    heads = np.zeros(need.shape, bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        heads[row, at] = True
        at = at + step[row, at]
        live = at < end[row]
        row, at = row[live], at[live]
    first = np.flatnonzero(heads.ravel())
    chosen = selector.ravel()[first].astype(np.int64)
    block = first // BLOCK
    count = np.minimum(COUNTS[chosen], block * BLOCK + end[block] - first)
    escaped = chosen == ESCAPE
    place = np.arange(len(first)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(first) + int(escaped.sum()), np.uint64)
    packed = chosen.astype(np.uint64) << np.uint64(60)
    width = WIDTHS[chosen].astype(np.uint64)
    for k in range(int(count.max())):
        on = np.flatnonzero((count > k) & ~escaped)
        if len(on):
            packed[on] |= padded[first[on] + k] << (width[on] * np.uint64(k))
    words[place] = packed
    words[place[escaped] + 1] = padded[first[escaped]]
    return words, place[np.searchsorted(first, np.arange(blocks) * BLOCK)].astype(np.uint64)


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of consecutive whole blocks; ``starts``: the first word of each."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    if (chosen == ESCAPE).any():  # the word after an escape is an id, whatever its bits
        for b in np.unique(block[chosen == ESCAPE]).tolist():
            w, end = int(starts[b]), int(starts[b + 1]) if b + 1 < len(starts) else len(words)
            while w < end:
                if chosen[w] == ESCAPE:
                    head[w + 1] = False
                    w += 1
                w += 1
    at = np.flatnonzero(head)
    chosen, block = chosen[at], block[at]
    whole = COUNTS[chosen]
    before = np.cumsum(whole) - whole
    opens = np.searchsorted(block, np.arange(len(starts)))
    inside = before - before[opens][block]
    size = np.minimum(BLOCK, n - block * BLOCK)
    count = np.minimum(whole, size - inside)
    out = np.empty(n, np.uint64)
    first = block * BLOCK + inside
    escaped = chosen == ESCAPE
    width = WIDTHS[chosen].astype(np.uint64)
    mask = (np.uint64(1) << np.minimum(width, np.uint64(60))) - np.uint64(1)
    for k in range(int(count.max())):
        on = np.flatnonzero((count > k) & ~escaped)
        out[first[on] + k] = (words[at[on]] >> (width[on] * np.uint64(k))) & mask[on]
    out[first[escaped]] = words[at[escaped] + 1]
    return out


def to_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = encode(ids.astype(np.uint64))
    head = HEADER.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(starts), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, their lengths, and all ids of an image."""
    magic, block, docs, n, blocks, size = HEADER.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not an image of token ids")
    parts, at = [], HEADER.size
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u8", blocks), ("<u8", size)):
        parts.append(np.frombuffer(image, kind, count, at))
        at += 8 * count
    doc_ids, lengths, starts, words = parts
    return doc_ids, lengths.astype(np.int64), decode(words, starts.astype(np.int64), n)


def block_ids(image: bytes, which: int) -> np.ndarray:
    """The ids of one block, without reading the others."""
    _, _, docs, n, blocks, size = HEADER.unpack_from(image)
    at = HEADER.size + 16 * docs
    starts = np.frombuffer(image, "<u8", blocks, at).astype(np.int64)
    lo, hi = int(starts[which]), int(starts[which + 1]) if which + 1 < blocks else size
    words = np.frombuffer(image, "<u8", hi - lo, at + 8 * blocks + 8 * lo)
    return decode(words, np.zeros(1, np.int64), min(BLOCK, n - which * BLOCK))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every text of ``docs(doc_id, text)``, each followed by ``end_id``, in ascending ``doc_id`` order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place = TaskContext.get().partitionId(), 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def image() -> pa.RecordBatch:
            nonlocal place, waiting
            numbers, lengths, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting, place = [], place + 1
            row = [[file], [place - 1], [len(ids)], [to_image(numbers, lengths, ids)]]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["file", "place", "n_ids", "image"])

        for b in batches:
            numbers = b.column(0).to_numpy(zero_copy_only=False)
            for first, ids, offsets in encoded(b.column(1), tokenizer):
                ended = np.insert(ids.astype(np.uint64), offsets[1:], end_id)
                waiting.append((numbers[first : first + len(offsets) - 1], np.diff(offsets) + 1, ended))
                if sum(len(x[2]) for x in waiting) >= IMAGE_IDS:
                    yield image()
        if waiting:
            yield image()

    ordered = docs.select(number().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(tasks(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(of, _IMAGES).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of the documents of written files."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, place, image in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                numbers, lengths, ids = from_image(image)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                same = [pa.array(np.full(len(numbers), x, np.int32)) for x in (file, place)]
                yield pa.record_batch([*same, pa.array(numbers), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["file", "place", "doc_id", "inside", "n_tokens", "ids_crc32"])

    images = spark.read.schema(_IMAGES).parquet(path)
    found = images.select("file", "place", "image").mapInArrow(of, "file int, place int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = images.select("file", "place", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file, then one per image of each file
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n_ids")).select("file", before(Window.orderBy("file")).alias("of_file"))
    places = sizes.select("file", "place", before(Window.partitionBy("file").orderBy("place")).alias("of_place")).join(files, "file")
    return found.join(places, ["file", "place"]).select(given(), (F.col("of_file") + F.col("of_place") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
