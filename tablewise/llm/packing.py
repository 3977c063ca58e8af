"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

How full the sequences get depends on the lengths alone, so the packing is decided on the histogram of lengths, which has
at most ``capacity`` entries however large the corpus is. A sequence is filled greedily, always with the longest length that still fits;
then its smallest length is replaced by the two unpacked lengths that fill the widened gap more tightly, if there are any.
The same filling is used as often as the counts allow before the next is sought, so there are some thousands of
fillings for any corpus. Every piece has a rank among the pieces of its length, and a filling takes an interval of ranks
of each of its lengths: that gives each piece its sequence and place without a task that sees a whole length.

Results in odd cases: null counts as empty text, a piece that holds the end id only; rows that repeat a ``doc_id`` are
packed one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import given, number, written
from tablewise.llm.tokens import encoded

#: Pieces of one length that one task ranks.
BUCKET_ROWS = 20_000
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``capacity`` ids if longer; the first piece takes the remainder."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(0).to_numpy(zero_copy_only=False)
            for first, ids, offsets in encoded(b.column(1), tokenizer):
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
                short = sizes - (count - 1) * capacity
                start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[doc])
                view = memoryview(ids.tobytes())
                at = offsets[:-1][doc] + start
                sums = [zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [pa.array(numbers[first + doc]), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(sums, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(number().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, _PIECES)


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Lengths that share a sequence, longest first, and how many sequences are filled so."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def longest(most: int) -> int:
        """The longest unpacked length up to ``most``, or 0."""
        have = np.flatnonzero(left[1 : most + 1])
        return int(have[-1]) + 1 if len(have) else 0

    while (length := longest(capacity)) > 0:
        inside, gap = [], capacity
        while length:
            inside.append(length)
            left[length] -= 1
            gap -= length
            length = longest(gap)
        smallest = inside[-1]
        room = gap + smallest
        best = (smallest, 0, 0)
        have = np.flatnonzero(left[: room + 1])
        for a in have.tolist():  # the pair a <= b that fills the room best
            left[a] -= 1
            b = longest(room - a)
            left[a] += 1
            if b >= a and a + b > best[0]:
                best = (a + b, b, a)
                if a + b == room:
                    break
        if best[1] and gap:
            left[smallest] += 1
            inside[-1:] = [best[1], best[2]]
            left[best[1]] -= 1
            left[best[2]] -= 1
        need = np.bincount(inside, minlength=capacity + 1)
        used = np.flatnonzero(need)
        more = int((left[used] // need[used]).min())
        left[used] -= need[used] * more
        out.append((inside, more + 1))
    return out


def places(found: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: from which rank on, the first sequence, and the place in it. Sorted by length and rank."""
    rows, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for inside, n in found:
        offset = 0
        for length in inside:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    columns = np.array(rows, np.int64).reshape(-1, 4)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "offset"), columns.T, strict=True))


def packed(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece."""
    cut = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = places(fillings(counts, capacity), capacity)
    parts = -(-max(counts.values(), default=1) // BUCKET_ROWS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_rank = table["length"] * (1 << 44) + table["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(5).to_numpy()
            at = np.searchsorted(from_rank, length * (1 << 44) + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.record_batch([*b.columns[:3], pa.array(length), b.column(4), pa.array(sequence), pa.array(table["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    along = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    split = cut.withColumn("part", part)
    before = split.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = split.withColumn("inside", inside).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    return ranked.mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("doc_id", given())
