"""Repair of the structure of conversations by iterative-deepening A*.

A conversation is sound when its roles' initials read ``(s?(ua)+)?`` and no turn is blank, a duplicate or cut off. Edits make it so: keep a
turn (K, 0), give it the role that is due (R, 3), delete it (D, 4; the only edit for blank turns and duplicates), or insert an empty turn of the
role that is due (I, 3); a turn that is cut off and stays costs 3 more. Of the cheapest edits those are taken whose initials come first in ASCII order.

*Search.* A state is how many turns are read and what the roles so far call for. Depth-first search tries the edits in ASCII order under a
cost bound; the bound grows to the least cost that went beyond it. A table keeps for each failed state what it costs at least from there on, so no
state is searched twice for the same bound; before that, every fault that no edit can mend for less counts. The first path that is accepted is the answer. Blank turns and
duplicates leave the search: they are always deleted, and before any insertion at their place.

*Long conversations.* Turns are numbered in order by a range partitioning, and cut into blocks of at most ``BLOCK`` unlike turns. A conversation
of no more turns than that is searched as a whole. Of others each block is searched from every state to every state; a chain over the blocks (16 numbers
each) picks the states between them, and the blocks' edits are put together. Equal turns of a conversation are counted before they are shuffled.

Results in odd cases: a null role or text is one space; a null ``conv_id`` is a conversation, a null turn comes first; turns of the same number are ordered by role, then text;
rows that repeat are duplicates of one turn; a conversation of no turns has no edits; very long texts stay whole (only their digest is compared); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import given, number, tasks, written

#: Unlike turns of a block, as a power of two.
BLOCK_BITS = 7
NEVER = 1 << 60
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: What a state calls for: 0 nothing read, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
DUE = ("user", "user", "assistant", "user")
AFTER_DUE = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SOUND = (0, 3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def least_costs(turns: str) -> tuple[list[int], list[int]]:
    """What the turns from each on cost at least, if something was read before, and if not.

    ``turns`` has an initial for each turn (x: another), a capital if it is cut off. A turn of a role that is never due again is changed or deleted; of two
    neighbours of one role one is changed or deleted, or there is an insertion between them, and pairs that share no turn add up.
    """
    n = len(turns)
    single, pairs, open_ = [0] * (n + 1), [0] * (n + 2), [0] * (n + 1)
    saved = 0
    for i in range(n - 1, -1, -1):
        role, cut = turns[i].lower(), turns[i].isupper()
        wrong = role in "sx"
        single[i] = single[i + 1] + (min(REROLE + cut * CUT_OFF, DELETE) if wrong else cut * CUT_OFF)
        pairs[i] = pairs[i + 1]
        if i + 1 < n and not wrong and turns[i + 1].lower() == role:
            more = DELETE - CUT_OFF if cut or turns[i + 1].isupper() else INSERT
            pairs[i] = max(pairs[i], more + pairs[i + 2])
        if role == "s":  # one system turn may stay if nothing was read before it
            saved = max(saved, DELETE - CUT_OFF if cut else REROLE)
        open_[i] = max(0, single[i] + pairs[i] - saved)
    return [a + b for a, b in zip(single, pairs, strict=False)], open_


@lru_cache(maxsize=50_000)
def cheapest(turns: str, entry: int, exit_: int | None) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of ``turns`` from state ``entry`` to ``exit_``, where the last turn's edit comes last; None: to a sound end."""
    n = len(turns)
    if exit_ is not None and n == 0 and exit_ != entry:
        return NEVER, ""
    read, unread = least_costs(turns)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def least(i: int, state: int) -> int:
        if exit_ is None or exit_ > 1:
            return failed.get((i, state)) or (read if state else unread)[i]
        if state > exit_:
            return NEVER
        if state == exit_:  # nothing more may stay
            return DELETE * (n - i)
        return DELETE * (n - i) - (DELETE if "s" in turns[i:] else DELETE - CUT_OFF) if "s" in turns[i:].lower() else NEVER

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Edit, its cost and the state after it, in ASCII order."""
        due = AFTER_DUE[state]
        if i == n:
            return [] if exit_ is not None else [("I", INSERT, n, due)]
        cut = CUT_OFF * turns[i].isupper()
        found = [("D", DELETE, i + 1, state), ("I", INSERT, i, due)]
        kept = KEPT[state].get(turns[i].lower())
        if kept is not None:
            found.append(("K", cut, i + 1, kept))
        return [*found, ("R", REROLE + cut, i + 1, due)]

    def reached(i: int, state: int, left: int) -> bool:
        if least(i, state) > left:
            return False
        if i == n and (state in SOUND if exit_ is None else state == exit_):
            return True
        beyond = NEVER
        for edit, cost, j, after in edits(i, state):
            if cost <= left and reached(j, after, left - cost):
                path.append(edit)
                return True
            beyond = min(beyond, cost + least(j, after))
        failed[i, state] = max(beyond, left + 1)
        return False

    bound = least(0, entry)
    if bound >= NEVER:
        return NEVER, ""
    while not reached(0, entry, bound):
        bound = least(0, entry)
    return bound, "".join(reversed(path))


def _block(rows: list[dict]) -> tuple[str, list[int], list[int]]:
    """Of a block's turns in order: those that stay in the search, how many are deleted before each and at the end, and the counts of faults and illegal neighbours."""
    turns, gone, counts, last = [], [0], [0, 0, 0, 0], None
    for r in rows:
        blank, again, cut = r["fault"] == "blank", r["fault"] == "duplicate", r["fault"] == "truncated"
        counts[0] += r["n"] * blank
        counts[1] += r["n"] - 1 + again if not blank else 0
        counts[2] += cut
        counts[3] += (r["n"] - 1) + (last is not None and (last, r["role"]) not in LEGAL)
        last = r["role"]
        if blank or again:
            gone[-1] += r["n"]
        else:
            turns.append(r["role"].upper() if cut else r["role"])
            gone.append(r["n"] - 1)
    return "".join(turns), gone, counts


def _with_deleted(edits: str, gone: list[int]) -> str:
    """Edits of all turns, from those of the turns that stay in the search."""
    out, k = ["D" * gone[0]], 0
    for e in edits:
        out.append(e)
        if e != "I":
            k += 1
            out.append("D" * gone[k])
    return "".join(out)


_FAULTS = "blank long, duplicate long, truncated long, illegal long"
_AUDITS = f"conv long, {_FAULTS}, cost long, audit string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations of one block."""
    for b in batches:
        out = []
        for rows in b.column(2).to_pylist():
            turns, gone, counts = _block(rows)
            cost, edits = cheapest(turns, 0, None)
            out.append((*counts, cost + DELETE * sum(gone), _with_deleted(edits, gone)))
        columns = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.string())]
        yield pa.record_batch([b.column(0), *columns], ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the costs from every state to every state, and for each first state the ASCII order of the edits to the others."""
    kinds = pa.schema([("conv", pa.int64()), ("block", pa.int64()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal")), ("ends", pa.string()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
    for b in batches:
        out = []
        for conv, block, rows in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            turns, gone, counts = _block(rows)
            costs, places = [], []
            for entry in range(4):
                found = [cheapest(turns, entry, e) for e in range(4)]
                costs += [min(NEVER, c + DELETE * sum(gone)) for c, _ in found]
                places += [sorted(e for _, e in found).index(e) for _, e in found]
            out.append(dict(zip(kinds.names, (conv, block, *counts, rows[0]["role"] + rows[-1]["role"], costs, places), strict=True)))
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each block of the cheapest edits of a conversation; blocks come in order."""
    closing = [0, 2 * INSERT, INSERT, 0]
    names = ["conv", "block", "entry", "exit", "closing", "total", "across"]

    def picked(conv: int, blocks: list[tuple]) -> pa.RecordBatch:
        to_go = [closing]
        for _, _, costs, _ in reversed(blocks):
            to_go.append([min(costs[4 * q + m] + to_go[-1][m] for m in range(4)) for q in range(4)])
        to_go.reverse()
        state, last, out = 0, None, []
        for k, (block, ends, costs, places) in enumerate(blocks):
            options = [m for m in range(4) if costs[4 * state + m] + to_go[k + 1][m] == to_go[k][state]]
            after = min(options, key=lambda m: places[4 * state + m])
            across = int(last is not None and (last, ends[0]) not in LEGAL)
            out.append((conv, block, state, after, "I" * (closing[after] // INSERT) if k + 1 == len(blocks) else "", to_go[0][0] if k == 0 else 0, across))
            state, last = after, ends[1]
        return pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names)

    conv, blocks = None, []
    for b in batches:
        for c, *block in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if c != conv and blocks:
                yield picked(conv, blocks)
                blocks = []
            conv = c
            blocks.append(tuple(block))
    if blocks:
        yield picked(conv, blocks)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block between the states that were picked."""
    for b in batches:
        out = []
        for rows, entry, exit_, closing in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
            turns, gone, _ = _block(rows)
            out.append(_with_deleted(cheapest(turns, entry, exit_)[1], gone) + closing)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], ["conv", "block", "piece"])


def _ordered(conversations: DataFrame, copies: Column | int) -> DataFrame:
    """Unlike turns with their number of rows ``n`` and ``place``, a number that grows along each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    copies = copies if isinstance(copies, Column) else F.lit(copies)
    rows = conversations.select(number("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role, text, copies.cast("long").alias("n"))
    order = ["conv", "turn", "role", "text"]
    rows = written(rows.groupBy(*order).agg(F.sum("n").alias("n")).where("n > 0"), "turns")
    rows = rows.repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order)
    return written(rows.withColumns({"place": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2("text", 256))}), "ordered")


def _judged(rows: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``n``, the initial and the first fault of each turn."""
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    rows = rows.select("conv", "place", "n", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    again = rows.where("fault IS NULL OR fault <> 'blank'").groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    judged = rows.join(again, ["conv", "role", "digest"], "left")
    return judged.select("conv", "place", "n", F.col("initial").alias("role"), F.when(F.col("fault").eqNullSafe("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("fault")).alias("fault"))


def _audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation."""
    block = F.shiftright("place", BLOCK_BITS).alias("block")
    blocks = _judged(rows).groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("place", "n", "role", "fault"))).alias("rows"))
    blocks = written(blocks, "blocks")
    split = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("rows")).alias("turns")).where("blocks > 1")
    split = written(split.select("conv", (F.col("turns") <= 1 << BLOCK_BITS).alias("short")), "split")
    short = blocks.join(split.where("short"), "conv", "left_semi").groupBy("conv").agg(F.lit(0).cast("long").alias("block"), F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    whole = blocks.join(split, "conv", "left_anti").unionByName(short).select("conv", "block", "rows").mapInArrow(_whole, _AUDITS)
    many = split.where("NOT short")
    if many.isEmpty():
        return whole
    parts = blocks.join(many, "conv", "left_semi").select("conv", "block", "rows")
    costed = written(parts.mapInArrow(_between, f"conv long, block long, {_FAULTS}, ends string, costs array<long>, places array<long>"), "costs")
    along = costed.select("conv", "block", "ends", "costs", "places").repartition("conv").sortWithinPartitions("conv", "block")
    picked = written(along.mapInArrow(_chained, "conv long, block long, entry long, exit long, closing string, total long, across long"), "states")
    pieces = parts.join(picked, ["conv", "block"]).select("conv", "block", "rows", "entry", "exit", "closing").mapInArrow(_pieces, "conv long, block long, piece string")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    pieces = pieces.groupBy("conv").agg(audit.alias("audit"))
    sums = costed.join(picked, ["conv", "block"]).groupBy("conv")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("across")).alias("illegal"), F.sum("total").alias("cost"))
    return whole.unionByName(sums.join(pieces, "conv"))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of the repaired conversations; each conversation's edits come first, then its turns in order."""
    audit, at, state, conv = "", 0, 0, None
    names = ["conv", "edit", "role", "text"]

    def inserted(out: list[tuple]) -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            out.append((conv, "I", DUE[state], ""))
            state, at = AFTER_DUE[state], at + 1

    for b in batches:
        out: list[tuple] = []
        for c, role, text, n, edits in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if edits is not None:
                inserted(out)
                audit, at, state, conv = edits, 0, 0, c
                continue
            while n:
                inserted(out)
                edit = audit[at]
                if edit == "D":  # equal turns are deleted together
                    end = at + n
                    while at < end and audit[at] == "D":
                        at, n = at + 1, n - 1
                    continue
                at, n = at + 1, n - 1
                out.append((conv, edit, role if edit == "K" else DUE[state], text))
                state = KEPT[state][role[0]] if edit == "K" else AFTER_DUE[state]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names) if out else pa.record_batch([pa.array([], pa.int64()), *[pa.array([], pa.string())] * 3], names)
    out = []
    inserted(out)
    if out:
        yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names)


def repaired(conversations: DataFrame, copies: Column | int = 1) -> tuple[DataFrame, DataFrame]:
    """A report per conversation and the turns of the repaired conversations, of ``conversations(conv_id, turn, role, text)``.

    The report has ``conv`` (``number`` of ``conv_id``), ``gaps`` (turn numbers missing between the first and the last), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (neighbours whose roles don't follow each other), ``cost`` and ``audit`` (the edits' initials). The turns have ``conv``, ``edit``, ``role`` and ``text``;
    all turns of a conversation are in one partition, in order. ``copies`` says how often a row counts (0: not at all).
    """
    rows = _ordered(conversations, copies)
    audits = written(_audits(rows), "audits")
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    seen = conversations.select(number("conv_id").alias("conv")).distinct()
    report = seen.join(gaps, "conv", "left").join(audits, "conv", "left").na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])
    edits = audits.select("conv", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    along = rows.select("conv", "place", "role", "text", "n", F.lit(None).cast("string").alias("audit")).unionByName(edits).repartition("conv").sortWithinPartitions("conv", "place")
    return report, along.select("conv", "role", "text", "n", "audit").mapInArrow(_walked, "conv long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of turns that stand in order: the hash of ``role:text`` lines joined by newlines, fed turn by turn."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            out = []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["conv", "repaired_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    return turns.select("conv", "role", "text").mapInArrow(of, "conv long, repaired_sha256 string")


def with_conv_id(df: DataFrame) -> DataFrame:
    """``conv_id`` as it was given in place of ``conv``."""
    return df.withColumn("conv_id", given("conv")).drop("conv")
