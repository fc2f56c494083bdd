"""Synonyms and exclusions: a parameter of matching, read from tables or from a user's JSON file."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.functions import text

SCHEMA = "group_id int, pos int, term string"
#: A few groups that any dictionary should have; the rest comes with the user's file.
CORE = [
    ["项目负责人", "负责人", "责任人", "项目责任人"],
    ["项目经理", "项目经理人", "项目经手人"],
    ["法定代表人", "法人代表", "法人"],
    ["项目名称", "工程名称", "名称"],
    ["项目编号", "项目编码", "项目代码"],
    ["建设单位", "业主单位"],
    ["联系电话", "电话", "联系方式"],
]
FILE = "map<string,array<string>>"


def lexicon(spark: SparkSession, groups: list[list[str]] = CORE) -> DataFrame:
    """Groups of synonyms as a table (group_id, pos, term, norm); the first of a group is its standard word."""
    rows = [(g, p, t) for g, group in enumerate(groups) for p, t in enumerate(group) if t and t.strip()]
    return with_norm(spark.createDataFrame(rows, SCHEMA))


def with_norm(terms: DataFrame) -> DataFrame:
    return terms.withColumn("norm", text.norm_field(F.col("term"))).where("norm <> ''")


def canonical(terms: DataFrame) -> DataFrame:
    """Rows (norm, groups, canon): the groups of a term, and the standard word of the last of them."""
    standard = terms.where("pos = 0").select("group_id", F.col("norm").alias("standard"))
    return terms.join(standard, "group_id").groupBy("norm").agg(F.collect_set("group_id").alias("groups"), F.max_by("standard", "group_id").alias("canon"))


def from_json(spark: SparkSession, content: DataFrame, column: str = "value", first_group: int = 100_000) -> DataFrame:
    """The synonym groups {"synonyms": {standard: [word, ...]}} of JSON texts as lexicon rows; malformed texts give none."""
    parsed = content.select(F.from_json(column, f"synonyms {FILE}").alias("j")).select(F.explode("j.synonyms").alias("standard", "words"))
    numbered = parsed.where(F.trim("standard") != "").select((F.abs(F.xxhash64("standard")) % 1_000_000_000 + first_group).cast("int").alias("group_id"), F.concat(F.array("standard"), F.coalesce("words", F.array())).alias("all"))
    return with_norm(numbered.select("group_id", F.posexplode("all").alias("pos", "term")).where("term is not null and trim(term) <> ''"))


def exclusions(content: DataFrame, column: str = "value") -> DataFrame:
    """The pairs (a, b) of {"exclusions": [{"a":, "b":}]}, normalised; pairs of one name are left out."""
    parsed = content.select(F.explode(F.from_json(column, "exclusions array<struct<a:string,b:string,reason:string>>")["exclusions"]).alias("e"))
    pairs = parsed.select(text.norm_field(F.col("e.a")).alias("a"), text.norm_field(F.col("e.b")).alias("b"))
    return pairs.where("a <> '' and b <> '' and a <> b").distinct()


def dictionary_path(*folders: str, name: str = "user_synonyms.json") -> str | None:
    """The first of the folders' dictionary files that exists."""
    return next((p for f in folders if os.path.exists(p := os.path.join(f, name))), None)


def check(data: dict) -> dict:
    """A dictionary as it is saved: lists of words that are not blank. Raises ValueError for any other form."""
    synonyms = data.get("synonyms", {})
    if not isinstance(synonyms, dict) or not all(isinstance(v, list) and all(isinstance(w, str) for w in v) for v in synonyms.values()):
        raise ValueError("synonyms must map a word to a list of words")
    clean = {k.strip(): [w.strip() for w in v if w.strip()] for k, v in synonyms.items() if k.strip()}
    return {"version": data.get("version", 1), "updated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "synonyms": clean, "exclusions": data.get("exclusions", [])}


def save(data: dict, path: str) -> dict:
    """Write a checked dictionary, exclusions included, so that readers see the old file or the new one."""
    clean = check(data)
    new = f"{path}.new"
    with open(new, "w", encoding="utf-8") as out:
        json.dump(clean, out, ensure_ascii=False, indent=2)
    os.replace(new, path)
    return clean


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return check(json.load(f))
