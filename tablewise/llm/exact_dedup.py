"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct digests in order, each with the row that stays and
the number of rows. Runs are then merged in rounds. A run's place is a number of several digits;
in each round the partners that differ in one digit exchange the parts of their runs, so that every
entry moves to the partner that owns its digest in that digit, and the parts that meet are merged in
one pass over sorted entries. After the last round each place holds a finished range of digests. Copies
meet as early as possible: however large a group is, a place gets at most one entry of it from each partner.

Results in odd cases: null counts as empty text, and all texts without a character outside white space
form one group; a null ``doc_id`` counts as
the smallest. Ties go to the smaller ``doc_id``; rows that repeat a ``doc_id`` with an equal text are
counted, and stay or go together in ``exact_groups`` and ``without_copies``; ``one_of_each`` keeps exactly one row of each group:
of rows that tie, the one with the smallest text key, then the smallest columns. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.arrays import WHITE, flat
from tablewise.llm.shared import given, number, one_row_each, tasks, text_key, written

_WHITE = bytes(np.flatnonzero(WHITE).astype(np.uint8))
_DIGESTS = "doc_id long, n_chars long, own long, digest binary, normal_bytes long, run int"
_RUN = "place int, digest binary, normal_bytes long, n_chars long, keep_id long, keep_own long, group_size long"


def digests(docs: DataFrame, runs: int) -> DataFrame:
    """SHA-256 of each text without white space, its length in code points, its key, and the run of its partition."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() % runs
        for b in batches:
            data, offsets = flat(b.column(3))
            view = memoryview(data)
            found, sizes = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = bytes(view[lo:hi]).translate(None, _WHITE)
                found.append(hashlib.sha256(text).digest())
                sizes.append(len(text))
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.full(len(found), run, np.int32))],
                ["doc_id", "n_chars", "own", "digest", "normal_bytes", "run"],
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select(number().alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), text_key().alias("own"), text.alias("text")).mapInArrow(of, _DIGESTS)


def _merged(entries: DataFrame) -> DataFrame:
    """Neighbouring entries of equal digest in each sorted partition become one; the first of them stays."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, kind = None, None
        for b in batches:
            if not len(b):
                continue
            kind = kind or b.schema
            t = pa.Table.from_batches([b] if rest is None else [rest.cast(kind), b]).combine_chunks()
            place, size = t["place"].to_numpy(), t["normal_bytes"].to_numpy()
            digest = np.frombuffer(b"".join(t["digest"].to_pylist()), "V32")
            new = np.ones(len(place), bool)
            same = (place[1:] == place[:-1]) & (digest[1:] == digest[:-1])
            if (same & (size[1:] != size[:-1])).any():
                raise ValueError("two texts of different length have one SHA-256")
            new[1:] = ~same
            at = np.flatnonzero(new)
            out = t.take(pa.array(at)).set_column(6, "group_size", pa.array(np.add.reduceat(t["group_size"].to_numpy(), at)))
            out = out.combine_chunks().to_batches()[0]
            yield out.slice(0, len(out) - 1)
            rest = out.slice(len(out) - 1)
        if rest is not None:
            yield rest

    ordered = entries.sortWithinPartitions("place", "digest", F.desc("n_chars"), "keep_id", "keep_own")
    return ordered.mapInArrow(of, _RUN)


def leaders(found: DataFrame, radix: int, rounds: int) -> DataFrame:
    """One row per digest: the row that stays and the size of its group, after ``rounds`` rounds of merging."""
    entries = _merged(
        found.select(
            F.col("run").alias("place"), "digest", "normal_bytes", "n_chars", F.col("doc_id").alias("keep_id"), F.col("own").alias("keep_own"), F.lit(1).cast("long").alias("group_size")
        )
    )
    home = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % (radix**rounds)
    for r in range(rounds):
        unit = radix**r
        digit = lambda x, unit=unit: F.floor(x / unit) % radix
        moved = F.col("place") + (digit(home) - digit(F.col("place"))) * unit
        entries = _merged(entries.withColumn("place", moved.cast("int")).repartition(radix**rounds, "place"))
    return entries.drop("place")


def _led(docs: DataFrame, radix: int) -> DataFrame:
    """The digest of every row with the row that stays of its group."""
    rounds = 1
    while radix**rounds < tasks(docs):
        rounds += 1
    found = written(digests(docs, radix**rounds), "digests")
    return found.join(leaders(found, radix, rounds).select("digest", "keep_id", "keep_own", "group_size"), "digest")


def exact_groups(docs: DataFrame, radix: int = 16) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of every row of ``docs(doc_id, text)``.

    ``radix`` is the number of partners of a round; there are as many rounds as give every shuffle task a place.
    """
    return _led(docs, radix).select(given(), given("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest")


def without_copies(docs: DataFrame, radix: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_groups(docs, radix).where("kept").select(number().alias("_stay")).distinct()
    return docs.join(stay, number() == stay["_stay"], "left_semi")


def one_of_each(docs: DataFrame, radix: int = 16) -> DataFrame:
    """Exactly one row of each group of equal texts, with all its columns, whatever its ``doc_id``."""
    first = _led(docs, radix).where("doc_id = keep_id AND own = keep_own")
    stay = first.groupBy(F.col("doc_id").alias("_stay"), F.col("own").alias("_text")).agg(F.count(F.lit(1)).alias("_rows"))
    return one_row_each(docs, written(stay, "kept"))
