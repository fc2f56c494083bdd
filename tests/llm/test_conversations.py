"""Conversation repair against a plain search over all edits, in one block and in many."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfuse.llm import conversations

ROWS = "conv long, turn long, role string, text string"
WS = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        out += [(conv, turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def plain(rows):
    """The result for each conversation by a plain search that keeps whole edit strings."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    found = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        counts, seen, best = [0, 0, 0], set(), {"": (0, "", ())}
        grow = lambda best: {k: min(v for q, v in ways if q == k) for ways in [list(best)] for k in {q for q, _ in ways}}
        step = lambda q: "u" if q in ("", "s", "a") else "a"

        def inserted(best):
            ways = list(best.items())
            for q, (c, e, t) in best.items():
                for _ in range(2):
                    q, c, e, t = step(q), c + 2, e + "I", (*t, {"u": "user:", "a": "assistant:"}[step(q)])
                    ways.append((q, (c, e, t)))
            return ways

        for _, _, role, text in own:
            blank, again, cut = not text.strip(WS), (role, text) in seen, text.strip(WS)[-1:] not in (".", "!", "?")
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                counts[fault] += 1
            ways = []
            for q, (c, e, t) in inserted(best):
                ways.append((q, (c + 3, e + "D", t)))
                if fault not in (0, 1):
                    c += fault == 2
                    ways.append((step(q), (c + 2, e + "R", (*t, {"u": "user:", "a": "assistant:"}[step(q)] + text))))
                    if role[:1] == "s" and q == "" or role[:1] in ("u", "a") and step(q) == role[:1]:
                        ways.append((role[:1], (c, e + "K", (*t, f"{role}:{text}"))))
            best = grow(ways)
        cost, audit, lines = min(v for q, v in inserted(best) if q in ("", "a"))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def result(df):
    return {r.conv: tuple(r)[1:] for r in df.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_rows(convs, most, seed):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "super", None]
    texts = ["Yes.", "No!", "and then", "", " \t\n", "ok?", "é. \n", "x.\u0085", None, "fine.", "a.b c"]
    rows = []
    for c in range(convs):
        n = int(rng.integers(1, most))
        for t in range(n):
            role = roles[rng.integers(9)] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = texts[rng.integers(11)] if rng.random() < 0.5 else f"text {rng.integers(99)}."
            rows.append((None if c == 0 else c, None if rng.random() < 0.05 else int(t * 2 - 3 + rng.integers(3)), role, text))
    return rows


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_conversations_against_plain_search(spark):
    rows = random_rows(150, 14, 1)
    df = spark.createDataFrame(rows, ROWS).withColumn("kinds", F.lit(1)).withColumn("block", F.lit("x")).repartition(5)
    kept = df.select("conv", "turn", "role", "text")
    assert sorted(conversations.damaged(kept).collect(), key=repr) == sorted(damage(rows), key=repr)
    got, want = result(conversations.repair(conversations.damaged(kept), kept)), plain(damage(rows))
    empty = hashlib.sha256(b"").hexdigest()
    for conv in {r[0] for r in rows}:
        assert got.pop(conv) == want.get(conv, (0, 0, 0, 0, 0, 0, "", empty))
    assert not got


def test_long_conversations_in_many_blocks_and_ranges(spark, monkeypatch, many_ranges):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    rows = [r for r in random_rows(12, 90, 2)] + [(7, 5, "user", "same.")] * 30 + [(8, 1, "tool", "cut")] * 9
    kept = spark.createDataFrame(rows, ROWS)
    assert result(conversations.repair(conversations.damaged(kept), kept)) == plain(damage(rows))


def test_empty_table_and_lost_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversations.repair(none, none).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "Hi.")], ROWS)
    assert result(conversations.repair(conversations.damaged(one), one)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_halves_meet_as_the_whole(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 200):
        kinds = bytes(rng.integers(0, 12, n).tolist())
        got = conversations.repaired(kinds, 0, None, True)
        parts = [kinds[i : i + 5] for i in range(0, n, 5)]
        states = conversations.crossings([conversations.summary(p) for p in parts], 0, None)
        pieces = [conversations.repaired(p, a, b, b is states[-1] and i == len(parts) - 1) for i, (p, a, b) in enumerate(zip(parts, [0, *states], states, strict=False))]
        assert "".join(p["audit"] for p in pieces) == got["audit"] and sum(p["cost"] for p in pieces) == got["cost"]
    assert conversations.joined([conversations.summary(kinds[:90]), conversations.summary(kinds[90:])]) == conversations.summary(kinds)
