"""Alignment and leaders in tasks, by components and by rounds; candidates of strings of all lengths."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfuse.functions import kernels
from loomfuse.operators import keys, row_match


def loop(rows):
    taken, used_t, used_s = set(), set(), set()
    for score, t, s in sorted(((x[2], x[0], x[1]) for x in rows), key=lambda r: (-r[0], r[1], r[2])):
        if t not in used_t and s not in used_s:
            taken.add((t, s))
            used_t.add(t)
            used_s.add(s)
    return taken


def scored(spark, rows):
    return spark.createDataFrame([("a", t, s, f"t{t}", f"s{s}", x) for t, s, x in rows], "source_id string, t_ord long, s_ord long, tgt_key string, src_key string, score double")


def aligned(df):
    return {(r.t_ord, r.s_ord) for r in row_match.align(df).collect()}


def test_path_of_uneven_ties(spark, monkeypatch):
    rng = random.Random(3)
    at = rng.sample(range(500), 500)
    rows = [(at[i], at[j], 0.9) for i in range(500) for j in (i, i + 1) if j < 500]
    tables = []
    monkeypatch.setattr(row_match, "kept", lambda df, label, old=row_match.kept: tables.append(label) or old(df, label))
    assert aligned(scored(spark, rows)) == loop(rows)
    assert tables.count("align-best") == 0


@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_tasks_components_and_rounds_agree(spark, monkeypatch, most):
    rng = random.Random(4)
    rows = list({(t, s): (t, s, rng.choice([0.85, 0.9, 0.92, 1.0])) for t, s in ((rng.randrange(40), rng.randrange(40)) for _ in range(70))}.values())
    monkeypatch.setattr(row_match, "LOCAL", most)
    assert aligned(scored(spark, rows)) == loop(rows)


def test_greedy_pass_over_kinds_with_many_members():
    rng = random.Random(5)
    for _ in range(30):
        kinds = {side: [sorted(rng.sample(range(60), rng.randint(1, 5))) for _ in range(6)] for side in "ts"}
        for side in "ts":  # a place belongs to one kind
            seen = set()
            kinds[side] = [[o for o in k if not (o in seen or seen.add(o))] for k in kinds[side]]
        links = [(t, s, rng.choice([0.85, 0.9, 1.0])) for t in range(6) for s in range(6) if rng.random() < 0.5]
        every = [(t, s, x) for a, b, x in links for t in kinds["t"][a] for s in kinds["s"][b]]
        members = [pa.table({"source_id": ["a"] * n, "side": [i] * n, "kind": [k for k, os in enumerate(kinds[x]) for _ in os], "rank": [r for os in kinds[x] for r in range(len(os))], "ord": [o for os in kinds[x] for o in os]}) for i, x in enumerate("ts") for n in [sum(map(len, kinds[x]))]]
        table = pa.table({"source_id": pa.array(["a"] * len(links), pa.string()), "t_kind": pa.array([x[0] for x in links], pa.int64()), "s_kind": pa.array([x[1] for x in links], pa.int64()), "score": pa.array([x[2] for x in links], pa.float64())})
        got = row_match.take_greedily(table, members).to_pylist()
        assert {(kinds["t"][r["t_kind"]][r["t_rank"]], kinds["s"][r["s_kind"]][r["s_rank"]]) for r in got} == loop(every)


def test_leaders_of_a_long_chain():
    n = 1000
    got = row_match.follow(pa.table({"ord": list(range(1, n)), "before": list(range(n - 1))})).to_pylist()
    assert {r["ord"]: r["leader"] for r in got} == {i: i if i % 2 == 0 else i - 1 for i in range(n)}


@pytest.mark.parametrize("most", [1, 6, 1000])
def test_leaders_by_tasks_components_and_rounds(spark, most):
    rng = random.Random(6)
    parts = ["示范山公园", "建设", "项目", "南片", "学校", "道路"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(25)})
    df = spark.createDataFrame(list(enumerate(names)), "ord long, key string")
    pairs = row_match.scored_candidates(df.select(F.col("ord").alias("t_ord"), F.col("key").alias("tgt_key")), df.select(F.lit("a").alias("source_id"), F.col("ord").alias("s_ord"), F.col("key").alias("src_key")), least=0.85)
    score = {(r.t_ord, r.s_ord) for r in pairs.collect()}
    want = {}
    for i in range(len(names)):
        want[i] = next((b for b in range(i) if want[b] == b and (i, b) in score), i)
    assert {r.ord: r.leader for r in row_match.leaders(df, most=most).collect()} == want and len(set(want.values())) < len(names)


def test_candidates_of_strings_of_all_lengths(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abc0") for _ in range(rng.choice([1, 2, 3, 4, 7, 10, 16, 25, 41, 70]))) for _ in range(40)]

    def changed(x):
        x = list(x)
        for _ in range(rng.randint(0, 1 + len(x) // 9)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "y"])
        return "".join(x) or "q"

    left, right = sorted({*base, *map(changed, base)}), sorted({*map(changed, base), *(x[2:] + "w" for x in base if len(x) > 2)})
    shaped = lambda names, o: spark.createDataFrame([("a", i, x, x, "", "00", [], None) for i, x in enumerate(names)], f"source_id string, {o} long, norm string, core string, domain string, digits string, codes array<string>, road struct<road:string>")
    got = {(r.t_ord, r.s_ord) for r in row_match.candidates(shaped(left, "t_ord"), shaped(right, "s_ord")).collect()}
    high = {(r.t_ord, r.s_ord) for r in row_match.candidates(shaped(left, "t_ord"), shaped(right, "s_ord"), 0.85).collect()}
    need, found = set(), 0
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            ratio, common = 2 * kernels.lcs_length(a, b) / (len(a) + len(b)), kernels.substring_length(a, b)
            inside = min(len(a), len(b)) >= 4 and (a in b or b in a)
            if inside or ratio >= 0.9 or (common >= 0.6 * min(len(a), len(b)) and ratio >= 0.7):
                found += 1
                need.add((i, j))
                assert (i, j) in got
                assert abs(len(a) - len(b)) / max(len(a), len(b)) > 0.34 or (i, j) in high
    assert found > 100 and len(got) < 3 * found


def test_only_keys_with_codes_of_others_are_spelled_out(spark, monkeypatch):
    """Keys whose codes no other key has can score over 0.6 as equal ones alone, so their pieces are not looked up; no pair is lost."""
    rng = random.Random(10)
    names = [f"{kind}#{i:09d}" for kind in ("Customer", "Supplier") for i in range(40)]
    names += ["".join(rng.choice("山河湖") for _ in range(rng.randint(2, 6))) + rng.choice(["", "A1", "B22"]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sorted(set(names)))), "ord long, key string")
    t, s = df.select(F.col("ord").alias("t_ord"), F.col("key").alias("tgt_key")), df.select(F.lit("a").alias("source_id"), F.col("ord").alias("s_ord"), F.col("key").alias("src_key"))
    spelled = []
    monkeypatch.setattr(row_match, "kept", lambda df, label, old=row_match.kept: spelled.append(old(df, label)) or spelled[-1] if label == "row-spelled" else old(df, label))
    got = {(r.t_ord, r.s_ord): round(r.score, 9) for r in row_match.scored_candidates(t, s, least=0.85).collect()}
    a = row_match.features(t.withColumn("source_id", F.lit("a")), "tgt_key").select("t_ord", *[F.col(c).alias(f"t_{c}") for c in row_match.FEATURES])
    b = row_match.features(s, "src_key").select("s_ord", *[F.col(c).alias(f"s_{c}") for c in row_match.FEATURES])
    want = {(r.t_ord, r.s_ord): round(r.score, 9) for r in row_match.score_pairs(a.crossJoin(b)).where("score >= 0.85").select("t_ord", "s_ord", "score").collect()}
    assert got == want and len(want) > len(names)
    assert len(spelled) == 2 and all(0 < x.count() <= 40 and x.where("norm like '%#%'").isEmpty() for x in spelled)


def test_ranks_within_groups_of_any_size(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x"]), rng.choice([1, 2]), i) for i in range(700)]
    rng.shuffle(rows)
    got = keys.numbered_within(spark.createDataFrame(rows, "k string, g int, o long").repartition(5), ["k", "g"], ["o"], "rank").collect()
    groups = {}
    for k, g, o in sorted(rows, key=lambda r: r[2]):
        groups.setdefault((k, g), []).append(o)
    assert len(got) == len(rows) and all(groups[r.k, r.g][r.rank] == r.o for r in got)
