"""Operator 12: repair of conversations' structure by the cheapest edits, found by Hirschberg's divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import table, written

#: Rows of a conversation that one task repairs at a time; longer conversations are repaired block by block.
BLOCK_BITS = 12
#: Positions count from 0 in each sorted range, and ranges by this power of two.
RANGE_BITS = 33
BLANKS = " \t\n\x0b\f\r"
NO_COST = 1 << 60

# Roles so far are nothing (0), a system turn (1), or end with a user's (2) or an assistant's turn (3).
STATES = range(4)
#: What an inserted or rerolled turn leads to, and its role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What turns inserted at the end cost: only nothing and an assistant's turn may end a conversation.
END_COST, END = (0, 4, 2, 0), ("", "II", "I", "")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A row's kind: the initial of its role (s, u, a, other), 4 more if it must go, 8 more if it is truncated.
KINDS = range(12)
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _steps(kind: int, state: int) -> list[tuple[int, int, int, str]]:
    """The ways (next state, cost, place, edits) over one row, the cheapest and then least for each next state; places
    number them in the order of their edits. No two edits of one state are equal or begin one another."""
    initial, must_go, add = kind % 4, kind // 4 == 1, TRUNCATED if kind // 4 == 2 else 0
    best: dict[int, tuple[int, str]] = {}
    at, cost, done = state, 0, ""
    for _ in range(3):  # more inserted turns only lead round
        ways = [(at, DELETE, "D")]
        if not must_go:
            ways.append((NEXT[at], REROLE + add, "R"))
            if initial == 0 and at == 0:
                ways.append((1, KEEP + add, "K"))
            if initial in (1, 2) and NEXT[at] == initial + 1:
                ways.append((NEXT[at], KEEP + add, "K"))
        for to, more, edit in ways:
            best[to] = min(best.get(to, (NO_COST, "")), (cost + more, done + edit))
        at, cost, done = NEXT[at], cost + INSERT, done + "I"
    place = {edits: i for i, edits in enumerate(sorted(e for _, e in best.values()))}
    return [(to, c, place[e], e) for to, (c, e) in sorted(best.items())]


STEPS = [[_steps(k, s) for s in STATES] for k in KINDS]
Vector = list[tuple[int, int]]


def start(state: int) -> Vector:
    return [(0 if s == state else NO_COST, 0) for s in STATES]


def _ranked(found: list[tuple[int, tuple[int, int]]]) -> Vector:
    order = sorted(place for cost, place in found if cost < NO_COST)
    return [(cost, order.index(place)) if cost < NO_COST else (NO_COST, 0) for cost, place in found]


def forward(kinds: bytes, lo: int, hi: int, vector: Vector) -> Vector:
    """For each state after rows lo..hi-1 the least cost and the place of its least edits among the four."""
    for k in kinds[lo:hi]:
        best = [(NO_COST, (0, 0))] * 4
        for s, (cost, rank) in enumerate(vector):
            if cost < NO_COST:
                for to, more, place, _ in STEPS[k][s]:
                    if (way := (cost + more, (rank, place))) < best[to]:
                        best[to] = way
        vector = _ranked(best)
    return vector


def backward(kinds: bytes, lo: int, hi: int, costs: list[int]) -> list[int]:
    """For each state before row lo the least cost from there over rows lo..hi-1, given what follows."""
    for k in reversed(kinds[lo:hi]):
        costs = [min(more + costs[to] for to, more, _, _ in STEPS[k][s]) for s in STATES]
    return costs


def crossing(before: Vector, after: list[int]) -> int:
    """Where the cheapest edits cross, of equal ones the least: edits up to different crossings differ before either ends."""
    return min((cost + after[s], rank, s) for s, (cost, rank) in enumerate(before) if cost < NO_COST)[2]


def hirschberg(kinds: bytes, lo: int, hi: int, entry: int, leave: int, edits: list[str]) -> None:
    """Appends the least of the cheapest edits of each row that lead from state ``entry`` to ``leave``.

    Costs meet in the middle, the crossing is chosen, and both halves are done alike; nothing is
    kept but two vectors a level and the edits themselves.
    """
    if hi - lo == 1:
        edits.append(next(e for to, _, _, e in STEPS[kinds[lo]][entry] if to == leave))
        return
    mid = (lo + hi) // 2
    after = [0 if s == leave else NO_COST for s in STATES]
    cross = crossing(forward(kinds, lo, mid, start(entry)), backward(kinds, mid, hi, after))
    hirschberg(kinds, lo, mid, entry, cross, edits)
    hirschberg(kinds, mid, hi, cross, leave, edits)


def illegal(kinds: bytes) -> int:
    return sum((a % 4, b % 4) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


# A stretch of a conversation as seen from outside: 16 costs, 16 places (by entry, then leaving state), its first and last kind, its illegal pairs.
SUMMARY = "costs array<long>, places array<int>, first int, last int, illegal long"


def summary(kinds: bytes) -> dict:
    vectors = [forward(kinds, 0, len(kinds), start(s)) for s in STATES]
    return {"costs": [c for v in vectors for c, _ in v], "places": [p for v in vectors for _, p in v], "first": kinds[0], "last": kinds[-1], "illegal": illegal(kinds)}


def joined(parts: list[dict]) -> dict:
    """The summary of stretches that follow each other."""
    vectors = [start(s) for s in STATES]
    for part in parts:
        for e, vector in enumerate(vectors):
            best = [(NO_COST, (0, 0))] * 4
            for s, (cost, rank) in enumerate(vector):
                for to in STATES:
                    if (total := cost + part["costs"][4 * s + to]) < NO_COST:
                        best[to] = min(best[to], (total, (rank, part["places"][4 * s + to])))
            vectors[e] = _ranked(best)
    between = sum((a["last"] % 4, b["first"] % 4) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    return {"costs": [c for v in vectors for c, _ in v], "places": [p for v in vectors for _, p in v], "first": parts[0]["first"], "last": parts[-1]["last"], "illegal": between + sum(p["illegal"] for p in parts)}


def crossings(parts: list[dict], entry: int, leave: int | None) -> list[int]:
    """The state after each stretch, on the least of the cheapest ways from ``entry`` to ``leave`` (None: to a proper end)."""
    after = [list(END_COST) if leave is None else [0 if s == leave else NO_COST for s in STATES]]
    for part in reversed(parts[1:]):
        after.append([min(part["costs"][4 * s + to] + after[-1][to] for to in STATES) for s in STATES])
    found, state = [], entry
    for part, rest in zip(parts, reversed(after), strict=True):
        state = crossing([(part["costs"][4 * state + to], part["places"][4 * state + to]) for to in STATES], rest)
        found.append(state)
    return found


def repaired(kinds: bytes, entry: int, leave: int | None, last: bool) -> dict:
    """A stretch's edits as one text, their cost, and the turns that stay: (place, initials inserted before, new role or null);
    an empty role stands for a turn that goes, but with others inserted before it, place -1 for the conversation's end."""
    vector = forward(kinds, 0, len(kinds), start(entry))
    leave = crossing(vector, list(END_COST)) if leave is None else leave
    edits: list[str] = []
    hirschberg(kinds, 0, len(kinds), entry, leave, edits)
    state, lines, waiting = entry, [], ""
    for at, edit in enumerate(edits):
        for e in edit[:-1]:
            waiting += ROLE[state][0]
            state = NEXT[state]
        if edit[-1] != "D":
            role = ROLE[state] if edit[-1] == "R" else None
            state = 1 if edit[-1] == "K" and kinds[at] % 4 == 0 else NEXT[state]
            lines.append({"at": at, "before": waiting, "role": role})
            waiting = ""
        elif waiting:
            lines.append({"at": at, "before": waiting, "role": ""})
            waiting = ""
    for _ in END[state] if last else "":
        waiting += ROLE[state][0]
        state = NEXT[state]
    if waiting:
        lines.append({"at": -1, "before": waiting, "role": None})
    return {"audit": "".join(edits) + (END[leave] if last else ""), "cost": vector[leave][0] + (END_COST[leave] if last else 0), "lines": lines}


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with damage done by a hash of conversation and turn; nulls of role and text, and in the hash, count as one space.

    A row is dropped (0), loses its text (1) or its full stops and question and exclamation marks (2), stands twice (3) or
    becomes the user's (4), if the hash leaves that remainder by 20.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("damage", F.crc32(name.cast("binary")) % 20).where("damage <> 0")
    text = F.coalesce("text", blank)
    return rows.select(
        "conv", "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, digest, blank, truncated, pos): texts stay behind, ``pos`` rises within each conversation by one.

    Sorted by ranges of all that identifies a row, so a conversation of any length is spread over many tasks.
    """
    last = F.right(_trimmed(F.col("text")), F.lit(1))
    facts = rows.select("conv", "turn", "role", _digest("text"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "digest", "row"]
    ranged = facts.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("pos", F.monotonically_increasing_id()).drop("row"), "turns")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest")


def _blocks(turns: DataFrame) -> DataFrame:
    """Rows (conv, block, pos, kinds, blanks, duplicates, truncations): the kinds of at most a block of rows, a byte each, in order."""
    firsts = turns.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    facts = turns.select("conv", "role", "blank", "truncated", "pos").join(firsts, "pos", "left")
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", F.lit(3)).otherwise(initial)
    again = ~F.col("blank") & F.col("first").isNull()
    cut = ~F.col("blank") & ~again & F.col("truncated")
    kind = initial + F.when(F.col("blank") | again, 4).when(cut, 8).otherwise(0)
    facts = facts.select("conv", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "blank", again.alias("again"), cut.alias("cut"), F.lpad(F.hex(kind), 2, "0").alias("kind"))
    kinds = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), ""))  # at most a block
    counts = [F.count_if(c).alias(name) for c, name in (("blank", "blanks"), ("again", "duplicates"), ("cut", "truncations"))]
    return written(facts.groupBy("conv", "block").agg(F.min("pos").alias("pos"), kinds.alias("kinds"), *counts), "turn-blocks")


def _each(rows: DataFrame, use, fields: str) -> DataFrame:
    """``rows`` with further ``fields`` from ``use``, a function of a row as a dictionary that gives a dictionary."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [use(r) for r in b.to_pylist()]
            columns = [pa.array([g[n] for g in got], TYPES[n]) for n in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])

    return rows.mapInArrow(run, f"{schema}, {fields}")


LINES = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.string()), ("role", pa.string())]))
TYPES = {"costs": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "first": pa.int32(), "last": pa.int32(), "illegal": pa.int64(), "audit": pa.string(), "cost": pa.int64(), "lines": LINES, "states": pa.list_(pa.int32())}
PART = ["costs", "places", "first", "last", "illegal"]


def _gathered(parts: DataFrame, by: list[str], key: str) -> DataFrame:
    """The summaries of each group in order, as ``parts``."""
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key, *PART))).alias("parts"))


def _ends(blocks: DataFrame) -> DataFrame:
    """Rows (conv, block, entry, leave, last) of conversations that lie in several blocks, and (conv, illegal) of each.

    Blocks are summed up for each range, ranges for each conversation; then the crossings between ranges
    are chosen, and between the blocks of each range. No task sees more than the blocks of a range, or the
    ranges of a conversation, each a summary of fixed size.
    """
    shift = RANGE_BITS - BLOCK_BITS
    summed = written(_each(blocks, lambda r: summary(r["kinds"]), SUMMARY).select("conv", "block", F.shiftright("block", shift).alias("range"), *PART), "turn-sums")
    by_range = written(_gathered(summed, ["conv", "range"], "block"), "turn-ranges")
    ranges = _each(by_range, lambda r: joined(r["parts"]), SUMMARY).select("conv", "range", *PART)
    whole = _each(_gathered(ranges, ["conv"], "range"), lambda r: {"states": crossings(r["parts"], 0, None), "illegal": joined(r["parts"])["illegal"]}, "states array<int>, illegal long")
    whole = written(whole, "turn-wholes")

    at = lambda i: F.get("states", i)
    dealt = lambda key: [F.posexplode(F.transform("parts", lambda p: p[key])).alias("pos", key), "states", (F.size("parts") - 1).alias("n")]
    chosen = whole.select(F.col("conv").alias("of"), "illegal", *dealt("range")).withColumnRenamed("range", "range_of")
    chosen = chosen.select("of", "range_of", "illegal", F.coalesce(at(F.col("pos") - 1), F.lit(0)).alias("entry"), at(F.col("pos")).alias("leave"), (F.col("pos") == F.col("n")).alias("final"))
    inner = by_range.join(chosen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("range") == F.col("range_of"))).drop("of", "range_of")
    inner = _each(inner, lambda r: {"states": crossings(r["parts"], r["entry"], r["leave"])}, "states array<int>")
    inner = inner.select("conv", "entry", "final", F.col("illegal").alias("whole_illegal"), *dealt("block"))
    return inner.select("conv", "block", F.coalesce(at(F.col("pos") - 1), F.col("entry")).alias("entry"), at(F.col("pos")).alias("leave"), (F.col("final") & (F.col("pos") == F.col("n"))).alias("last"), "whole_illegal")


def _hashes(rows: DataFrame, turns: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows (conv, repaired_sha256): texts, each once, and what stays of them meet in order, and are hashed as they pass.

    A row of ``rows`` and its line have the same turn, role and digest; of equal rows one line at most keeps its text.
    """
    lines = solved.select("conv", "pos", F.explode("lines").alias("l")).select("conv", F.when(F.col("l.at") >= 0, F.col("pos") + F.col("l.at")).alias("pos"), "l.before", F.col("l.role").alias("new"))
    lines = written(lines, "turn-lines")
    own = turns.select("pos", "turn", "role", "digest")
    names = ["conv", "final", "turn", "role", "digest", "pos", "before", "new", "text"]
    inside = lines.where("pos is not null").join(own, "pos").select("conv", F.lit(0).alias("final"), "turn", "role", "digest", "pos", "before", "new", F.lit(None).cast("string").alias("text"))
    ends = lines.where("pos is null").select("conv", F.lit(1).alias("final"), F.lit(None).cast(dict(turns.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), "pos", "before", "new", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv", F.lit(0).alias("final"), "turn", "role", _digest("text"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("new"), "text")
    every = texts.select(names).unionByName(inside.select(names)).unionByName(ends.select(names))
    kind = dict(turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, empty, text, field, some = None, None, True, "", None, False
        out: list[tuple] = []
        for b in batches:
            field = b.schema.field("conv").type
            for r in b.select(["conv", "role", "before", "new", "text"]).to_pylist():
                if not some or r["conv"] != conv:
                    if some:
                        out.append((conv, state.hexdigest()))
                    conv, state, empty, some = r["conv"], hashlib.sha256(), True, True
                if r["before"] is None:
                    text = r["text"]
                    continue
                added = [f"{'user' if c == 'u' else 'assistant'}:" for c in r["before"]]
                if r["new"] != "" and r["role"] is not None:
                    added.append(f"{r['new'] or r['role']}:{text}")
                for line in added:
                    state.update((line if empty else f"\n{line}").encode())
                    empty = False
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], field), pa.array([h for _, h in out])], ["conv", "repaired_sha256"])
                out = []
        if some:
            out.append((conv, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], field), pa.array([h for _, h in out])], ["conv", "repaired_sha256"])

    return every.repartition("conv").sortWithinPartitions("conv", "final", "turn", "role", "digest", F.col("pos").asc_nulls_first()).mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """One row for each ``conv`` of ``originals``: faults, cost and edits of ``rows`` (conv, turn, role, text), and a hash of what results.

    Rows of a conversation go by turn, nulls first, then role and digest of the text; nulls of role or text are not
    allowed here. The first fault of a row counts: blank, duplicate (role and text stood before), truncated
    (its last character that isn't blank is no full stop, question or exclamation mark). Edits are Keep (0), Rerole to user or assistant (2),
    Delete (3), and Insert of an empty turn (2); blank and duplicate rows must go, truncated ones that stay cost 1 more. The cheapest edits
    that leave an optional system turn and then user and assistant in turn, or nothing, are found; of equal ones the audit (their
    initials) least in ASCII. A role that begins with neither s, u nor a, or is empty, can't be kept.

    Duplicates are told by the least position of equal rows. Conversations are sorted by ranges and repaired
    in blocks of 4,096 rows, by divide and conquer inside a block; of a conversation that lies in several blocks each is summed up by 16 costs first, and
    the same choice is made between blocks. Only the hash of the result, which is one chain of bytes, passes a conversation's
    texts through one task, as a stream.
    """
    turns = _placed(rows)
    stats = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.shiftright(F.min("pos"), BLOCK_BITS).alias("a"), F.shiftright(F.max("pos"), BLOCK_BITS).alias("b"))
    stats = written(stats, "turn-stats")
    blocks = _blocks(turns)
    long = stats.where("a <> b").select(F.col("conv").alias("of"))
    work = blocks.select("conv", "block", "pos", "kinds", "blanks", "duplicates", "truncations")
    if long.isEmpty():
        work = work.withColumns({"entry": F.lit(0), "leave": F.lit(None).cast("int"), "last": F.lit(True), "whole_illegal": F.lit(None).cast("long")})
    else:
        ends = written(_ends(blocks.select("conv", "block", "kinds").join(long, F.col("conv").eqNullSafe(F.col("of")), "left_semi")), "turn-ends").withColumnsRenamed({"conv": "of", "block": "block_of"})
        work = work.join(ends, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("block_of")), "left").drop("of", "block_of")
        work = work.withColumns({"entry": F.coalesce("entry", F.lit(0)), "last": F.coalesce("last", F.lit(True))})
    solve = lambda r: repaired(r["kinds"], r["entry"], r["leave"], r["last"]) | {"illegal": illegal(r["kinds"])}
    solved = written(_each(work, solve, "audit string, cost long, illegal long, lines array<struct<at:int,before:string,role:string>>"), "turn-solved")

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")  # a conversation's audit is one cell
    sums = solved.groupBy("conv").agg(F.sum("blanks").alias("blank"), F.sum("duplicates").alias("duplicate"), F.sum("truncations").alias("truncated"), F.coalesce(F.max("whole_illegal"), F.sum("illegal")).alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    parts = originals.select("conv").distinct()
    for more in (stats.select("conv", "gaps"), sums, _hashes(rows, turns, solved)):
        parts = parts.unionByName(more, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return repair(damaged(rows), rows).withColumnRenamed("conv", "conv_id")


QUERIES = {"op12_conversations": op12_conversations}
_WS = r"\x20\x09-\x0D"
SQL = {
    "op12_conversations": rf"""
WITH RECURSIVE hashed AS (
  SELECT *, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS damage
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE r END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
    unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), told AS (
  SELECT *, substr(role, 1, 1) AS x, NOT regexp_matches(text, '[^{_WS}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '([^{_WS}])[{_WS}]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS w, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), inserts(q, q1, cost, edits, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])
), ways AS (
  SELECT t.conv_id, t.i, s.q, s.q1, e.edit, CASE e.edit WHEN 'D' THEN s.q1 WHEN 'R' THEN CASE s.q1 WHEN 2 THEN 3 ELSE 2 END ELSE CASE t.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q2,
    s.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND cut THEN 1 ELSE 0 END AS cost, s.edits || e.edit AS edits,
    list_concat(s.lines, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE s.q1 WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END) AS lines
  FROM told t, inserts s, (VALUES ('D'), ('K'), ('R')) AS e(edit)
  WHERE e.edit = 'D' OR NOT blank AND NOT again AND (e.edit = 'R' OR t.x = 's' AND s.q1 = 0 OR t.x = 'u' AND s.q1 IN (0, 1, 3) OR t.x = 'a' AND s.q1 = 2)
), path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM told
  UNION ALL
  SELECT p.conv_id, p.i + 1, w.q2, min({{'cost': p.best.cost + w.cost, 'audit': p.best.audit || w.edits, 'lines': list_concat(p.best.lines, w.lines)}})
  FROM path p JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.q = p.q GROUP BY ALL
), ended AS (
  SELECT p.conv_id, min({{'cost': p.best.cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': p.best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': list_concat(p.best.lines, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS best
  FROM path p JOIN (SELECT DISTINCT conv_id, n FROM told) t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.i GROUP BY p.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (w IS NOT NULL AND w || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
}
