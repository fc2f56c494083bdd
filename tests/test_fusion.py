"""Row keys, fields, headers, fills and workbooks, on small cases."""

import io
import random
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfuse.functions import kernels, text
from loomfuse.operators import fill, headers, keys, lexicon, row_match, schema_match
from loomfuse.plans import text_queries
from loomfuse.sources import grid, sink


def norms(spark, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, k string")
    return [r[0] for r in rows.orderBy("i").select(text.norm_rowkey(F.col("k"))).collect()]


@pytest.mark.parametrize(("a", "b"), [
    ("示范大道之南段", "示范大道"), ("示范南路之北段", "示范南路"), ("示范路之A段", "示范路"), ("A路之B段", "A路"), ("示范路及示范北路段", "示范路"), ("示范大道及南段", "示范大道"),
    ("A至B", "a"), ("A到B", "a"), ("示范大道至示范路", "示范大道"), ("示范大道到示范路", "示范大道"), ("某路（A路-B路）", "某路"), ("Ａ路Ｂ段", "A路B段"), (" 示范 城市 ", "示范城市"), (None, ""), ("", ""), ("　\t", ""),
])
def test_equal_row_keys(spark, a, b):
    x, y = norms(spark, a, b)
    assert x == y


@pytest.mark.parametrize(("a", "b"), [("示例学校", "示例学校及周边道路填土夯实工程"), ("示范河排渍泵站", "示范河排渍泵站及配套管网建设工程"), ("示范新城片保障性住房(一期)", "示范新城片保障性住房(二期)及配套道路")])
def test_different_row_keys(spark, a, b):
    x, y = norms(spark, a, b)
    assert x != y


def scores(spark, pairs, **options):
    left = row_match.features(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, key string"))
    right = row_match.features(spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "j int, key string"))
    t = left.select("i", *[F.col(c).alias(f"t_{c}") for c in row_match.FEATURES])
    s = right.select(F.col("j").alias("i"), *[F.col(c).alias(f"s_{c}") for c in row_match.FEATURES])
    return [round(r.score, 6) for r in row_match.score_pairs(t.join(s, "i"), **options).orderBy("i").collect()]


LIGHTS = ["示范城市之光医院门诊综合楼二期项目", "示范城市之光商业综合体项目", "示范城市之光写字楼三期项目"]


def test_row_scores(spark):
    cases = [
        ("某项目", "某项目", 1.0), (None, "某项目", 0.0), ("甲一期项目", "甲二期项目", 0.0), ("甲第1标段", "甲第2标段", 0.0), ("甲公司", "甲合同", 0.0), ("XM-2024001甲", "2024001 乙", 0.92), ("示范山公园建设", "某示范山公园建设", 0.97),
        ("某路（A路-B路）东", "某路（B路-A路）西", 0.97), ("某路（A-B）东", "某路（C-D）西", 0.0), ("某山项目", "某山工程", 1.0), ("甲乙丙P10", "甲乙丙P12", 0.6), ("毫不相干", "另一件事", 0.0),
    ]
    got = scores(spark, [(a, b) for a, b, _ in cases])
    assert got == [s for _, _, s in cases]
    back = scores(spark, [(b, a) for a, b, _ in cases])
    assert back == got and all(0 <= s <= 1 for s in got)
    first = scores(spark, [("某山项目", "某山工程"), ("某路（A-B）", "某路（C-D）"), ("某项目", "某项目")], equality_first=True)
    assert first == [0.99, 0.0, 1.0]
    cross = scores(spark, [(a, b) for a in LIGHTS for b in LIGHTS])
    assert [s == 1 for s in cross] == [a == b for a in LIGHTS for b in LIGHTS]


def frames(spark, left, right):
    t = spark.createDataFrame(list(enumerate(left)), "t_ord long, tgt_key string")
    return t, spark.createDataFrame([("s", i, k) for i, k in enumerate(right)], "source_id string, s_ord long, src_key string")


@pytest.mark.parametrize("order", [1, -1])
def test_alignment_of_equal_keys(spark, order):
    got = row_match.align(row_match.scored_candidates(*frames(spark, LIGHTS, LIGHTS[::order])))
    assert {(r.tgt_key, r.src_key) for r in got.collect()} == {(k, k) for k in LIGHTS}


def test_candidates_lose_nothing_and_rounds_are_greedy(spark):
    rng = random.Random(5)
    parts = ["示范", "山", "湖", "公园", "道路", "建设", "项目", "工程", "一期", "二期", "A1", "B2", "2024001", "2024002", "安置房", "学校", "南片"]
    name = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
    left, right = sorted({name() for _ in range(60)}), sorted({name() for _ in range(60)})
    scored = row_match.scored_candidates(*frames(spark, left, right))
    got = {(r.tgt_key, r.src_key): round(r.score, 9) for r in scored.collect()}
    every = [(a, b) for a in left for b in right]
    want = {p: s for p, s in zip(every, scores(spark, every), strict=True) if s >= 0.6 - 1e-9}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-5 for p in want)
    taken, used_t, used_s = set(), set(), set()
    for r in sorted(scored.where("score >= 0.85").collect(), key=lambda r: (-r.score, r.t_ord, r.s_ord)):
        if r.t_ord not in used_t and r.s_ord not in used_s:
            taken.add((r.t_ord, r.s_ord))
            used_t.add(r.t_ord)
            used_s.add(r.s_ord)
    assert {(r.t_ord, r.s_ord) for r in row_match.align(scored).collect()} == taken
    assert {(r.t_ord, r.s_ord) for r in row_match.align_keys(*frames(spark, left, right)).collect()} == taken
    high = row_match.scored_candidates(*frames(spark, left, right), least=0.85)
    assert {(r.tgt_key, r.src_key) for r in high.collect()} == {p for p, s in want.items() if s >= 0.85 - 1e-9}
    named = spark.createDataFrame(list(enumerate(left)), "ord long, key string")
    own = {(a, b): s for (a, b), s in zip([(a, b) for a in left for b in left], scores(spark, [(a, b) for a in left for b in left]), strict=True)}
    leaders, expected = [], {}
    for k in left:
        expected[k] = next((x for x in leaders if own[k, x] >= 0.85), k)
        if expected[k] == k:
            leaders.append(k)
    assert {r.key: left[r.leader] for r in row_match.leaders(named).collect()} == expected


def test_equal_keys_align_in_few_rounds(spark, monkeypatch):
    left, right = [f"某路（{c}）" for c in "甲乙丙丁戊己庚辛壬癸子丑"], [f"某路 （{c}）" for c in "甲乙丙丁戊己庚辛壬"] + ["某路工程", "另一座桥"]
    tables = []
    monkeypatch.setattr(row_match, "kept", lambda df, label, old=row_match.kept: tables.append(label) or old(df, label))
    got = row_match.align_keys(*frames(spark, left, right))
    assert tables.count("align-best") == 0
    assert {(r.t_ord, r.s_ord) for r in got.collect()} == {(k, k) for k in range(9)}
    scored = row_match.scored_candidates(*frames(spark, left, right))
    assert {(r.t_ord, r.s_ord) for r in row_match.align(scored).collect()} == {(k, k) for k in range(9)}


def test_preview_names_every_target(spark):
    t, s = frames(spark, ["甲乙丙项目P10", "毫不相干", "示范山公园建设"], ["甲乙丙项目P12", "示范山公园建设"])
    got = {r.tgt_key: (r.src_key, r.score, r.status) for r in row_match.preview(t, s).collect()}
    assert got == {"甲乙丙项目P10": ("甲乙丙项目P12", 0.6, "suggest"), "毫不相干": (None, 0.0, "unmatched"), "示范山公园建设": ("示范山公园建设", 1.0, "auto")}
    assert [r.status for r in row_match.preview(t.where("t_ord = 1"), s).collect()] == ["unmatched"]


def test_kernels(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(80)]

    def slow(a, b):
        seq = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                seq[i + 1][j + 1] = seq[i][j] + 1 if x == y else max(seq[i][j + 1], seq[i + 1][j])
                run[i + 1][j + 1] = run[i][j] + 1 if x == y else 0
        return (2 * seq[-1][-1] / (len(a) + len(b)) if a or b else 1.0), max(map(max, run))

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    k = df.withColumn("k", kernels.pair_kernel("a", "b")).select("i", "k.ratio", "k.common", kernels.indel_ratio(F.col("a"), F.col("b")).alias("r"), kernels.common_substring(F.col("a"), F.col("b")).alias("c"))
    for r in k.collect():
        ratio, common = slow(*pairs[r.i])
        assert abs(r["ratio"] - ratio) < 1e-12 and r["common"] == common and abs(r.r - ratio) < 1e-12 and r.c == common


def test_kernels_of_strings_of_all_lengths(spark):
    rng = random.Random(9)
    word = lambda letters, most: None if rng.random() < 0.02 else "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    pairs = [(word(letters, most), word(letters, most)) for letters in ("ab", "abcd", "a鹊b鸦", "😀ab鹊c") for most in (1, 9, 30, 70, 300) for _ in range(40)]
    total, seq, run = kernels.pair_lengths(*(pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)))
    want = [(len(a) + len(b), kernels.lcs_length(a, b), kernels.substring_length(a, b)) for a, b in ((a or "", b or "") for a, b in pairs)]
    assert list(zip(total, seq, run, strict=True)) == want
    some = [i for i, (a, b) in enumerate(pairs) if a and b and len(a) < 80]
    df = spark.createDataFrame([(i, *pairs[i]) for i in some], "i int, a string, b string")
    for r in df.select("i", kernels.indel_ratio(F.col("a"), F.col("b")).alias("r"), kernels.common_substring(F.col("a"), F.col("b")).alias("c")).collect():
        assert abs(r.r - 2 * want[r.i][1] / want[r.i][0]) < 1e-12 and r.c == want[r.i][2]


def test_kernels_take_pairs_side_by_side(monkeypatch):
    """A dynamic program for all pairs of a batch, no step for each pair."""
    names = lambda kind: pa.array([f"{kind}#{i:09d}" for i in range(5000)])
    monkeypatch.setattr(kernels, "lcs_length", None)
    assert set(kernels.pair_lengths(names("Customer"), names("Supplier"))[2]) == {12}


def test_pairs_are_dealt_evenly(spark, tmp_path):
    """Each pair of a nation once, in tasks of about as many pairs, though one nation has most of them."""
    spark.range(900).selectExpr("id c_custkey", "'Customer#' || id c_name", "if(id < 700, 3, cast(id % 5 as int)) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id s_suppkey", "'Supplier#' || id s_name", "if(id < 40, 3, cast(id % 5 as int)) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    c, s = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("customer", "supplier"))
    want = {tuple(r) for r in c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey").collect()}
    pairs = text_queries.pairs_of_names(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(pairs) == len(want) and {(r.c_custkey, r.s_suppkey) for r in pairs} == want
    tasks = Counter(r.task for r in pairs)
    assert len(tasks) > 1 and max(tasks.values()) < 2 * len(pairs) / len(tasks)
    assert text_queries.similarity_native(spark, str(tmp_path)).exceptAll(text_queries.similarity_kernel(spark, str(tmp_path))).isEmpty()


def field_score(spark, pairs, **options):
    rows = spark.createDataFrame(pairs, "src string, tgt string")
    got = {(r.src, r.tgt): round(r.score, 4) for r in schema_match.score_fields(rows, lexicon.lexicon(spark), **options).collect()}
    return [got[p] for p in pairs]


def test_field_scores(spark):
    assert field_score(spark, [("项目负责人", "项目经理"), ("项目经理", "项目负责人"), ("法人代表", "项目经理")]) == [0.0, 0.0, 0.0]
    high = field_score(spark, [("负责人", "项目负责人"), ("项目负责人", "负责人"), ("项目经理", "项目经理人"), ("项目经理", "项目经手人"), ("法人代表", "法定代表人"), ("项目责任人", "责任人")])
    assert min(high) >= 85
    pairs = [("项目经理", "项目经理"), ("立项>审批文号", "审批文号"), ("金额（万元）", "金额（元）"), ("实际开工时间", "实际竣工时间"), ("甲路", "甲公司"), ("a b", "ab"), ("x/审批文号", "审批文号")]
    got = dict(zip(pairs, field_score(spark, pairs), strict=True))
    assert got[pairs[0]] == 100 and got[pairs[1]] == 95 and got[pairs[3]] == 0 and got[pairs[5]] == 98 and got[pairs[6]] == 98
    assert got[pairs[2]] <= 60 and got[pairs[4]] < 60
    same = ("负责人联系电话", "负责人联系电话")
    assert field_score(spark, [same], exact_first=True) == [100.0] and field_score(spark, [same])[0] < 85
    assert field_score(spark, [("甲名", "甲名x")], exclusions=[("甲名", "甲名x")]) == [0.0]
    assert field_score(spark, [("前乙名后", "前甲名后")], exclusions=[("甲名", "乙名")]) == [0.0]
    deep = "/".join("abcdefghijklmnop"[i] * (i + 2) for i in range(3))
    nested = ">".join(["p"] * 12 + [deep])
    assert field_score(spark, [(nested, "aa")])[0] == 98.0


def test_auto_match(spark):
    terms = lexicon.lexicon(spark)

    def match(src, tgt):
        pairs = spark.createDataFrame([(s, t) for s in src for t in tgt], "src string, tgt string")
        s = spark.createDataFrame([(i, n, "f", "s") for i, n in enumerate(src)], "ord int, name string, file string, sheet string")
        t = spark.createDataFrame(list(enumerate(tgt)), "ord int, name string")
        return schema_match.auto_match(schema_match.score_fields(pairs, terms), s, t).orderBy("ord").collect()

    assert not match(["项目经理"], ["项目负责人"])[0].matched
    best = match(["技术负责人", "项目经理"], ["项目经理"])[0]
    assert (best.src_field, best.confidence, best.matched, best.conflict) == ("项目经理", 100.0, True, False)
    assert [r.conflict for r in match(["项目经理"], ["项目经理", "项目经理人"])] == [True, True]


def test_dictionary(spark, tmp_path):
    content = '{"synonyms": {"标准": ["同义", " ", null]}, "exclusions": [{"a": "甲", "b": "乙"}, {"a": "丙", "b": " 丙"}]}'
    df = spark.createDataFrame([(content,), ("not json",)], "value string")
    assert sorted(r.term for r in lexicon.from_json(spark, df).collect()) == ["同义", "标准"]
    assert [tuple(r) for r in lexicon.exclusions(df).collect()] == [("甲", "乙")]
    path = str(tmp_path / "d.json")
    lexicon.save({"synonyms": {"a": ["b", " "]}, "exclusions": [{"a": "x", "b": "y"}]}, path)
    assert lexicon.load(path)["synonyms"] == {"a": ["b"]} and lexicon.load(path)["exclusions"] and lexicon.dictionary_path("/none", str(tmp_path), name="d.json") == path
    with pytest.raises(ValueError):
        lexicon.check({"synonyms": {"a": "b"}})


def test_rank_fill_equals_the_loop(spark):
    rng = random.Random(9)
    target = [(i, rng.choice("abc"), "f", "old") for i in range(25)]
    source = [(i, rng.choice("abcd"), rng.choice([None, "", f"v{i}"]), rng.randint(1, 4)) for i in range(18)]
    rows = spark.createDataFrame([("s", 0, i, k, n, "g", v) for i, k, v, n in source if v], "source_id string, source_order int, src_row long, key string, n_valid int, field string, value string")
    cells = spark.createDataFrame(target, "tgt_row long, key string, field string, value string")
    own = cells.select(F.lit("s").alias("source_id"), F.col("key").alias("tgt_key")).distinct()
    matches = spark.createDataFrame([("f", "g", "s")], "tgt_field string, src_field string, source_id string")
    eff = fill.effective_keys(own, own.limit(0).withColumn("src_key", F.lit(None).cast("string")))
    got = {r.tgt_row: r.value for r in fill.fill_cells(cells, rows, eff, matches).collect()}
    used, want = set(), {}
    for i, k, _, _ in target:
        best = next((r for r in sorted((r for r in source if r[1] == k and r[2]), key=lambda r: (-r[3], r[0])) if r[0] not in used), None)
        want[i] = best[2] if best else None
        if best:
            used.add(best[0])
    assert got == want


def test_overrides(spark):
    own = spark.createDataFrame([("s", k) for k in "abcd"], "source_id string, tgt_key string")
    aligned = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B")], "source_id string, tgt_key string, src_key string")
    given = spark.createDataFrame([("b", None), ("c", "Z")], "tgt_key string, src_key string")
    hard = {r.tgt_key: r.src_key for r in fill.effective_keys(own, aligned, given).collect()}
    soft = {r.tgt_key: r.src_key for r in fill.effective_keys(own, aligned, given, unbind="soft").collect()}
    assert hard == {"a": "A", "b": None, "c": "Z", "d": "d"} and soft == hard | {"b": "b"}


def test_keys(spark):
    df = spark.createDataFrame([(0, "x", None, " "), (1, None, "p", "q"), (2, "y", "p", None)], "row int, a string, b string, _col_0 string")
    assert keys.detect_key(df.drop("row")) == "a" and keys.resolve_key(["甲 名", "b"], "甲名") == "甲 名" and keys.resolve_key(["a", "b"], 1) == "b"
    filled = keys.forward_fill(df, "a", "row", block=1)
    assert [r.a for r in filled.orderBy("row").collect()] == ["x", "x", "y"]
    dotted = keys.forward_fill(df.withColumnRenamed("a", "a.b>c").withColumnRenamed("b", "No."), "a.b>c", "row", by=["No."])
    assert dotted.columns == ["row", "a.b>c", "No.", "_col_0"] and {r.row: r["a.b>c"] for r in dotted.collect()} == {0: "x", 1: None, 2: "y"}
    groups = spark.createDataFrame([(0, None, "x"), (1, None, None), (2, "g", None), (3, "g", "y"), (None, "g", None)], "row long, g string, k string")
    assert sorted((r.row if r.row is not None else -1, r.k) for r in keys.forward_fill(groups, "k", "row", by=["g"], block=2).collect() if r.row not in (None, 2)) == [(0, "x"), (1, "x"), (3, "y")]
    assert keys.forward_fill(groups, "k", "row", by=["g"]).count() == 5
    more = keys.expand_target(df.select("row", "a"), spark.createDataFrame([("n", 9), ("m", 4), ("x", 1)], "key string, ord long"), "a", "row")
    assert sorted((r.row, r.a) for r in more.where("row > 2").collect()) == [(3, "m"), (4, "n")]
    assert headers.clean_names(["a", None, "a", " ", "Unnamed: 3"]) == ["a", "_col_1", "a_2", "_col_2", "_col_3"]
    matches = spark.createDataFrame([(0, "项目编号", "x", True), (1, "立项名称", "y", True), (2, "备注", "z", True)], "ord int, tgt_field string, src_field string, matched boolean")
    counts = spark.createDataFrame([("项目编号", 0), ("立项名称", 5), ("备注", 9)], "tgt_field string, n_valid long")
    assert keys.row_key_candidates(matches, counts).where("rank = 1").first().tgt_field == "立项名称"


def cells_of(spark, sheets):
    rows = [(s, r, c, v, False) for s, g in sheets.items() for r, row in enumerate(g, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(rows, "sheet string, r int, c int, v string, in_merge boolean")


def test_header_zones(spark):
    sheets = {
        "single": [["name", "amount", "date"], ["x", "1", "2"], ["y", "3", "4"]],
        "title": [["Report", None, None], ["name", "amount", "date"], ["x", "1", "2"]],
        "repeated": [["Report", "Report", "Report"], ["name", "amount", "date"], ["x", "1", "2"]],
        "numbers": [["1", "2", "3"], ["name", "amount", "date"], ["x", "1", "2"]],
        "category": [["base", None, "money", None, "time"], ["name", "code", "amount", "paid", "day"], ["x", "y", "1", "z", "k"]],
    }
    merges = spark.createDataFrame([("title", 1, 1, 1, 2), ("category", 1, 1, 1, 2), ("category", 1, 1, 3, 4)], "sheet string, r1 int, r2 int, c1 int, c2 int")
    cells = headers.expand_merges(cells_of(spark, sheets), merges)
    zones = headers.header_zone(cells, merges)
    got = {r.sheet: (r.detail, list(r.categories)) for r in zones.collect()}
    assert got["single"] == (1, []) and got["repeated"][0] == 2 and got["numbers"][0] == 2
    assert got["category"] == (2, [1])
    # three levels; a short title above the header; narrow categories; a totals row; a wide sparse sheet; header without data
    more = {
        "levels": [["all"] + [None] * 7, ["base", None, None, "money", None, None, "time", None], list("abcdefgh"), ["x"] * 7 + ["1"], ["y", "z", None, "k", "m", "n", "o", "p"]],
        "short": [["Report", "2024"], ["one", "two", "three", "four", "five", "six"], list("uvwxyz"), list("abcdef")],
        "narrow": [["a", None, "b", None, "c"], ["v", "w", "x", "y", "z"], ["1", "k", "3", "m", "n"]],
        "total": [["合计", "10", "x", "y"], ["name", "n", "k", "m"], ["p", "1", "q", "r"]],
        "sparse": [[f"f{i}" for i in range(120)], ["only"] + [None] * 119, [None, "two"] + [None] * 118],
        "empty": [["Report", None, None], ["name", "amount", "date"]],
    }
    wide = spark.createDataFrame([("levels", 1, 1, 1, 8), ("levels", 2, 2, 1, 3), ("levels", 2, 2, 4, 6), ("levels", 2, 2, 7, 8), ("narrow", 1, 1, 1, 2), ("narrow", 1, 1, 3, 4)], "sheet string, r1 int, r2 int, c1 int, c2 int")
    grid_of_more = headers.expand_merges(cells_of(spark, more), wide)
    deep = {r.sheet: (r.detail, list(r.categories)) for r in headers.header_zone(grid_of_more, wide).collect()}
    assert deep == {"levels": (3, [2]), "short": (2, [1]), "narrow": (2, [1]), "total": (2, [1]), "sparse": (1, []), "empty": (2, [1])}
    old = {r.sheet: r.r for r in headers.legacy_header(grid_of_more).collect()}
    named = {r.sheet: r.r for r in headers.named_header(grid_of_more).collect()}
    assert old["total"] == 2 and named["sparse"] == 1 and named["short"] == 2
    names = {(r.sheet, r.c): r.name for r in headers.compound_names(cells, zones).collect()}
    assert names["category", 1] == "base>name" and names["category", 3] == "money>amount" and names["single", 2] == "amount"


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    sink.publish(sink.new_workbook(["name", "n"], [["x", "1"], [None, "<2>"]]), path)
    cells = grid.read_workbooks(spark, [path]).where("kind = 'cell'").select("sheet", "r", "c", "v", F.lit(False).alias("in_merge"))
    assert {(r.r, r.c): r.v for r in cells.collect()} == {(1, 1): "name", (1, 2): "n", (2, 1): "x", (2, 2): "1", (3, 2): "<2>"}
    table = headers.to_table(cells, "Sheet1", {"detail": 1}, ["name", "n"])
    assert [tuple(r) for r in table.orderBy("row_idx").collect()] == [(0, "x", "1"), (1, None, "<2>")]
    with open(path, "rb") as f:
        patched = sink.patch_workbook(f.read(), "Sheet1", {(3, 1): "new", (2, 1): " ", (5, 3): "far"}, 2)
    assert {(r, c): v for _, k, r, c, _, _, v, _ in grid.workbook(patched) if k == "cell"} == {(1, 1): "name", (1, 2): "n", (2, 1): "x", (2, 2): "1", (3, 1): "new", (3, 2): "<2>", (5, 3): "far"}
    plain = zipfile.ZipFile(path)
    odd = str(tmp_path / "odd.xlsx")
    with zipfile.ZipFile(odd, "w") as new:  # as spreadsheet programs write it: extension names, cells without references, regions, dates from 1904
        for n in plain.namelist():
            xml = plain.read(n).decode()
            if n == "xl/worksheets/sheet1.xml":
                xml = xml.replace("<worksheet ", '<worksheet xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="x14ac" xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac" ')
                xml = xml.replace(' r="B2"', "").replace('<row r="3">', "<row>").replace("</sheetData>", '</sheetData><mergeCells count="3"><mergeCell ref="A1:A1"/><mergeCell ref="A2:A3"/><mergeCell ref="A9:B9"/></mergeCells>')
            new.writestr(n, xml)
    same = {(r, c): v for _, k, r, c, _, _, v, _ in grid.workbook(open(odd, "rb").read()) if k == "cell"}
    assert same == {(1, 1): "name", (1, 2): "n", (2, 1): "x", (2, 2): "1", (3, 2): "<2>"}
    content, skipped = sink.filled_workbook(open(odd, "rb").read(), "Sheet1", ["n", "NAME", "gone"], [(0, "7", "y", "q"), (2, "9", None, None)], None)
    assert skipped == ["gone"]
    assert {(r, c): v for _, k, r, c, _, _, v, _ in grid.workbook(content) if k == "cell"} == {(1, 1): "name", (1, 2): "n", (2, 1): "y", (2, 2): "7", (3, 2): "<2>", (4, 2): "9"}
    assert [(r, c, r2, c2) for _, k, r, c, r2, c2, _, _ in grid.workbook(content) if k == "merge"] == [(1, 1, 1, 1), (9, 1, 9, 2)]
    sheet = zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml").decode()
    assert 'mc:Ignorable="x14ac"' in sheet and "xmlns:x14ac=" in sheet and "ns0:" not in sheet
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert [r.kind for r in grid.read_workbooks(spark, [str(tmp_path / "bad.xlsx")]).collect()] == ["error"]
    with pytest.raises(ValueError):
        grid.read_workbooks(spark, ["x.xls"])
    (tmp_path / "a.csv").write_text("a,a,\n1,2,3\n4,5,6\n", encoding="utf-8")
    csv = grid.read_delimited(spark, str(tmp_path / "a.csv"))
    assert csv.columns[0] == "row_idx" and [r.row_idx for r in csv.orderBy("row_idx").collect()] == [0, 1]
    (tmp_path / "b.csv").write_text('a,b\n"one\ntwo",x\n"say ""hi""",y\n', encoding="utf-8")
    assert [(r.a, r.b) for r in grid.read_delimited(spark, str(tmp_path / "b.csv")).orderBy("row_idx").collect()] == [("one\ntwo", "x"), ('say "hi"', "y")]


def test_columns_by_name():
    columns = ["基本>项目 名称", "金额（万元）", "x>备注(说明)", "_col_1"]
    assert schema_match.resolve_column(columns, "项目名称") == columns[0] and schema_match.resolve_column(columns, "none", "备注") == columns[2]
    assert schema_match.resolve_column(columns, "a>金额(万元)") == columns[1] and schema_match.resolve_column(columns, "other") is None
    like = lambda pairs: {p: 90.0 if p == (columns[1], "费用") else 10.0 for p in pairs}
    assert schema_match.resolve_column(columns, "费用", score=like) == columns[1] and schema_match.resolve_column(columns, "别", score=like) is None
    rows = {1: {1: "Report"}, 2: {1: "base", 2: "base"}, 3: {1: "name", 2: "Code", 3: "amount"}, 4: {1: "name"}}
    assert schema_match.header_row(rows, ["base>name", "code", "amount"]) == 3 and schema_match.header_row(rows, ["p", "q"], 2) == 2 and schema_match.header_row(rows, ["p", "q"]) == 1
    assert schema_match.header_places({1: {2: "kind"}, 2: {1: "name", 3: "n(万元)"}}, 2, ["a>name", "kind", "n（万元）", "lost"]) == {"a>name": 1, "kind": 2, "n（万元）": 3}


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r.field: (r.n_cells, r.n_filled) for r in entry.entry(spark).collect()}
    assert set(rows) == {"name", "balance"} and all(0 < b <= a for a, b in rows.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
