"""Conversation repair against exhaustive dynamic programming and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tablewise.llm import conversations as c

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best(rows):
    """Cheapest, ASCII-least edits and their turns of ``(role, text, fault)`` rows, over all states."""
    states = {0: (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, out) in list(states.items()):
                new = (cost + 3, audit + "I", (*out, ("assistant" if q == 2 else "user", "")))
                if NEXT[q] not in states or new < states[NEXT[q]]:
                    states[NEXT[q]] = new
        return states

    for role, text, fault in rows:
        after = {}

        def offer(q, cost, audit, out, after=after):
            if q not in after or (cost, audit) < after[q][:2]:
                after[q] = (cost, audit, out)

        for q, (cost, audit, out) in inserted(states).items():
            offer(q, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in KEEP:
                    offer(KEEP[q, role[:1]], cost + more, audit + "K", (*out, (role, text)))
                offer(NEXT[q], cost + 3 + more, audit + "R", (*out, ("assistant" if q == 2 else "user", text)))
        states = after
    return min((x for q, x in inserted(states).items() if q in (0, 3)), key=lambda x: x[:2])


def expected(table, damage):
    """The result by conversation of ``(conv_id, turn, role, text)`` rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else -1
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\v\f\r")
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, made = best(judged)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        faults = [sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_search_against_all_states():
    rng = random.Random(3)
    for _ in range(3000):
        turns = "".join(rng.choice("ssuuuuaaaaxSUAX") for _ in range(rng.randrange(9)))
        rows = [({"x": "tool"}.get(t.lower(), t.lower()), str(i), "truncated" if t.isupper() else "") for i, t in enumerate(turns)]
        assert c.cheapest(turns, 0, None) == best(rows)[:2], turns


def test_search_between_states():
    """Put together, the cheapest edits of two halves through the best state between them cost what the whole does."""
    rng = random.Random(6)
    for _ in range(300):
        turns = "".join(rng.choice("ssuuuaaaxSUAX") for _ in range(rng.randrange(2, 12)))
        k = rng.randrange(len(turns))
        halves = []
        for m in range(4):
            (a, x), (b, y) = c.cheapest(turns[:k], 0, m), c.cheapest(turns[k:], m, None)
            halves.append((a + b, x + y))
        assert min(halves) == c.cheapest(turns, 0, None), (turns, k)


def test_bounds_are_never_too_high():
    rng = random.Random(4)
    for _ in range(500):
        turns = "".join(rng.choice("suaxSUAX") for _ in range(rng.randrange(12)))
        for part, entry in ((c.least_costs(turns)[1], 0), (c.least_costs(turns)[0], 2), (c.least_costs(turns)[0], 3)):
            assert part[0] <= c.cheapest(turns, entry, None)[0]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    texts = ["Yes.", "No?", "cut off", "", " \t", None, "Ä! ", "end. \n", "x. ", "well..."]
    rows = [(k // 7, rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for k in range(420)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho."), (None, None, "system", "Be kind.")]
    rows += [(900, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(9)] * 2
    rows += [(901, 0, "user", "word " * 200_000 + "."), (901, 1, "assistant", "ok.")]
    rows += [(1000, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"{k}.", f"{k}", "same.", ""])) for k in range(700)]
    return rows + rows[:40]


@pytest.mark.parametrize("bits", [7, 2, 0])
def test_repair(spark, odd, bits, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 AS n", "'x' AS conv", "0 AS place", "'y' AS audit", "0 AS block")
    assert got(c_query(spark, df)) == expected(odd, True)
    report, turns = c.repaired(df)
    assert got(c.with_conv_id(report.join(c.digests(turns), "conv", "left").na.fill(hashlib.sha256(b"").hexdigest(), ["repaired_sha256"]))) == expected(odd, False)


def c_query(spark, df):
    from tablewise.llm import queries

    return queries.op11_conversation_repair(df)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c_query(spark, df).count() == 0
    one = spark.createDataFrame([(7, 3, "user", " ")], "conv_id long, turn long, role string, text string")
    assert [(r.blank, r.cost, r.audit) for r in c.repaired(one)[0].collect()] == [(1, 4, "D")]
