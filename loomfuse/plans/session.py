"""A session: sources and a target are added, fields matched, rows aligned, the target filled and written."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.functions import fixed, text
from loomfuse.operators import catalog, fill, headers, keys, lexicon, row_match, schema_match
from loomfuse.operators.scratch import kept
from loomfuse.sources import grid, sink


#: Rows of a sheet, by the format.
SHEET_ROWS = 1_048_575


@dataclass
class Options:
    """``policy``: locked (a match draws on its one source) or coalesce_latest. ``unbind``: hard or soft.
    ``exact_first``: equal names score 100 whatever their parts. ``equality_first``: only equal keys score 1.
    ``derive_key``: the matches tell the row key, whatever the caller names."""

    policy: str = "locked"
    unbind: str = "hard"
    exact_first: bool = True
    equality_first: bool = True
    derive_key: bool = True


@dataclass
class Source:
    source_id: str
    order: int
    file: str
    sheet: str
    table: DataFrame
    header: int | None = None

    @property
    def path_is_workbook(self) -> bool:
        return self.file.lower().endswith(".xlsx")


@dataclass
class Session:
    """The state of one user's work. Tables stay DataFrames; only names, matches and statistics come to the driver."""

    spark: SparkSession
    options: Options = field(default_factory=Options)
    groups: list[list[str]] = field(default_factory=lambda: lexicon.CORE)
    exclusions: list[tuple[str, str]] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    target: Source | None = None
    status: dict = field(default_factory=lambda: {"running": False, "pct": 0.0, "msg": "", "done": False, "aborted": False, "error": None, "result": None})
    dictionary: dict = field(default_factory=lambda: {"synonyms": {}, "exclusions": []})
    dictionary_file: str | None = None
    _tag: str = ""
    _jobs: int = 60

    # --- tables ---

    def _sheets(self, path: str, zone: dict | None, sheet: str | None = None) -> list[tuple[str, DataFrame, int | None]]:
        """The sheets of a file, or one of them, as (name, table, header row). Raises ValueError for what can't be read."""
        if path.lower().endswith((".xlsx", ".xls")):
            raw = kept(grid.read_workbooks(self.spark, [path]), "grid")
            if bad := raw.where("kind = 'error'").first():
                raise ValueError(f"{path}: {bad['v']}")
            raw = raw.where(F.col("sheet") == sheet) if sheet else raw
            cells = raw.where("kind = 'cell'").select("sheet", "r", "c", "v", F.lit(False).alias("in_merge"))
            merges = raw.where("kind = 'merge'").select("sheet", F.col("r").alias("r1"), F.col("r2"), F.col("c").alias("c1"), F.col("c2"))
            full = kept(headers.expand_merges(cells, merges), "grid-full")
            zones = headers.header_zone(full, merges)
            width = full.where(headers.filled(F.col("v"))).groupBy("sheet").agg(F.max("c").alias("n_columns"))
            older = headers.legacy_header(full).join(zones, "sheet", "left_anti").join(width, "sheet")
            plain = lambda df: df.select("sheet", F.col("r").alias("detail"), F.array().cast("array<int>").alias("categories"), "n_columns")
            zones = zones.unionByName(plain(older))
            last = headers.named_header(full).join(zones, "sheet", "left_anti").join(width, "sheet")  # where neither rule finds a row
            zones = zones.unionByName(plain(last))
            if zone:
                last = full.agg(F.max("r")).first()[0] or 1
                start = min(max(1, zone["start"]), last)
                end = min(max(start, zone["end"]), last)
                zones = kept(width.select("sheet", F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(end).alias("detail"), "n_columns"), "zones")
                names = headers.zone_names(full, zones)
            else:
                zones = kept(zones, "zones")
                names = headers.compound_names(full, zones)
            found = []
            for z in zones.orderBy("sheet").collect():  # a row for each sheet of one file
                columns = [r["name"] for r in names.where(F.col("sheet") == z["sheet"]).orderBy("c").collect()]
                found.append((z["sheet"], headers.to_table(full, z["sheet"], z.asDict(), columns), z["detail"]))
            if not found:
                raise ValueError(f"{path}: no sheet with a header")
            return found
        if path.lower().endswith(".csv"):
            return [("csv", grid.read_delimited(self.spark, path), None)]
        df = self.spark.read.parquet(path)
        return [("parquet", df if "row_idx" in df.columns else df.withColumn("row_idx", F.monotonically_increasing_id()), None)]

    def add_sources(self, paths: list[str], zones: dict[str, dict] | None = None) -> dict:
        """Adds the sheets of files that the session doesn't have yet; files that can't be read are told and skipped."""
        have, failed = {s.file.lower() for s in self.sources}, {}
        for path in paths:
            if path.lower() in have:
                continue
            have.add(path.lower())
            try:
                for sheet, df, header in self._sheets(path, (zones or {}).get(path)):
                    self.sources.append(Source(f"s{len(self.sources)}", len(self.sources), path, sheet, kept(df, "source"), header))
            except Exception as e:  # noqa: BLE001  one bad file must not lose the others
                failed[path] = str(e)
        return {"success": bool(self.sources), "sources": len(self.sources), "failed": failed}

    def set_target(self, path: str, zone: dict | None = None, sheet: str | None = None) -> dict:
        """Takes the template: the named sheet, else the first. A file that can't be read is told."""
        try:
            name, df, header = self._sheets(path, zone, sheet)[0]
        except Exception as e:  # noqa: BLE001  the caller asks what went wrong
            return {"success": False, "error": str(e)}
        self.target = Source("target", -1, path, name, kept(df, "target"), header)
        return {"success": True, "fields": self.target_fields()}

    def target_fields(self) -> list[str]:
        return [c for c in catalog.target_fields(self.target.table) if c != "row_idx"]

    def catalog(self) -> DataFrame:
        parts = [catalog.field_catalog(s.table, s.source_id, s.order, "row_idx").withColumn("file", F.lit(s.file)).withColumn("sheet", F.lit(s.sheet)) for s in self.sources]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def all_samples(self) -> DataFrame:
        return catalog.all_samples(self.catalog())

    # --- fields ---

    def _fields(self) -> tuple[DataFrame, DataFrame]:
        src = self.catalog().select((F.col("source_order") * 10_000 + F.col("ord")).alias("ord"), F.col("field").alias("name"), "file", "sheet")
        return src, self.spark.createDataFrame(list(enumerate(self.target_fields())), "ord int, name string")

    def scores(self) -> DataFrame:
        """Every target field against every source field: names of columns, so a small table."""
        src, _ = self._fields()
        pairs = src.select(F.col("name").alias("src")).distinct().withColumn("tgt", F.explode(F.array(*map(F.lit, self.target_fields())).cast("array<string>")))
        return schema_match.score_fields(pairs, lexicon.lexicon(self.spark, self.groups), self.exclusions, exact_first=self.options.exact_first)

    def auto_match(self) -> DataFrame:
        return kept(schema_match.auto_match(self.scores(), *self._fields()), "matches")

    def candidates(self, tgt_field: str, top: int = 30) -> DataFrame:
        return schema_match.ranked_candidates(self.scores().where(F.col("tgt") == tgt_field), self._fields()[0], top)

    def score_field(self, src: str, tgt: str) -> float:
        return self._scores([(src, tgt)])[src, tgt]

    def _scores(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
        """Scores of a few pairs of names."""
        df = self.spark.createDataFrame(pairs, "src string, tgt string")
        found = schema_match.score_fields(df, lexicon.lexicon(self.spark, self.groups), self.exclusions, exact_first=self.options.exact_first)
        return {(r["src"], r["tgt"]): r["score"] for r in found.collect()}

    def _resolve(self, columns: list[str], name: str | None, fallback: str | None = None) -> str | None:
        return schema_match.resolve_column([c for c in columns if c != "row_idx"], name or "", fallback or "", self._scores)

    # --- the dictionary ---

    def _take(self, data: dict) -> dict:
        content = self.spark.createDataFrame([(json.dumps(data, ensure_ascii=False),)], "value string")
        self.exclusions = [(r.a, r.b) for r in lexicon.exclusions(content).collect()]
        self.groups = [*lexicon.CORE, *[[k, *v] for k, v in data["synonyms"].items()]]
        self.dictionary = data
        return data

    def load_dictionary(self, path: str) -> dict:
        """A user's synonyms over the core groups, and its exclusions; a file that can't be read changes nothing."""
        data = self._take(lexicon.load(path))
        self.dictionary_file = path
        return data

    def reload_dictionary(self, *folders: str) -> dict:
        """The dictionary read again, from its file or else from the first of ``folders`` that has one."""
        path = self.dictionary_file or lexicon.dictionary_path(*(folders or (os.getcwd(),)))
        return self.load_dictionary(path) if path else self.dictionary

    def save_dictionary(self, data: dict, path: str | None = None) -> dict:
        path = path or self.dictionary_file or os.path.join(os.getcwd(), "user_synonyms.json")
        self.dictionary_file = path
        return self._take(lexicon.save(data, path))

    def import_dictionary(self, content: str, path: str | None = None) -> dict:
        """Takes over a dictionary given as JSON text and saves it; text that is none raises ValueError and changes nothing."""
        return self.save_dictionary(lexicon.check(json.loads(content)), path)

    def export_dictionary(self) -> str:
        return json.dumps(self.dictionary, ensure_ascii=False, indent=2)

    # --- rows ---

    def row_key_candidates(self) -> dict:
        """The names that may tell rows apart, each once, in order."""
        names = [r["field"] for r in self.catalog().orderBy("source_order", "ord").collect()]
        return {"success": True, "src": list(dict.fromkeys(names)), "tgt": list(dict.fromkeys(self.target_fields()))}

    def derived_key(self, matches: DataFrame) -> tuple[str | None, str | None]:
        """The source and target field that the matches tell to be the row key; none if that target column is empty."""
        counts = keys.valid_counts(self.target.table.drop("row_idx"))
        if not counts or not max(counts.values()):
            return None, None
        table = self.spark.createDataFrame(list(counts.items()), "tgt_field string, n_valid long")
        best = keys.row_key_candidates(matches, table).where("rank = 1").first()
        return (best["src_field"], best["tgt_field"]) if best and counts.get(best["tgt_field"]) else (None, None)

    def _target_key(self, matches: DataFrame | None, wanted: str | None) -> tuple[str | None, str]:
        src, tgt = self.derived_key(matches) if matches is not None and (self.options.derive_key or not wanted) else (None, None)
        return src, tgt or (wanted if wanted in self.target.table.columns else keys.detect_key(self.target.table.drop("row_idx")))

    def _source_key(self, source: Source, src_key: str | None, tgt_key: str) -> str:
        """A source's key column: that of the match, the target's, its last part, the fullest with a key word, the fullest."""
        columns = source.table.drop("row_idx")
        if found := self._resolve(columns.columns, src_key) if src_key else None:
            return found
        if found := self._resolve(columns.columns, tgt_key, tgt_key.rsplit(">", 1)[-1].strip()):
            return found
        named = columns.select(*[f"`{c}`" for c in columns.columns if any(w in c for w in fixed.SOURCE_KEY_WORDS)])
        return keys.detect_key(named) or keys.detect_key(columns)

    def _keyed(self, tgt_key: str, src_key: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
        value = lambda c: keys.key_text(F.col(f"`{c}`"))
        t = keys.distinct_in_order(self.target.table.select(value(tgt_key).alias("tgt_key"), F.col("row_idx").alias("t_ord")).where("tgt_key <> ''"), "tgt_key", "t_ord")
        parts, columns = [], {}
        for s in self.sources:
            columns[s.source_id] = key = self._source_key(s, src_key, tgt_key)
            filled = keys.forward_fill(s.table, key, "row_idx")
            own = keys.distinct_in_order(filled.select(value(key).alias("src_key"), F.col("row_idx").alias("s_ord")).where("src_key <> ''"), "src_key", "s_ord")
            parts.append(own.select(F.lit(s.source_id).alias("source_id"), "s_ord", "src_key"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return t, out, columns

    def alignment_preview(self, tgt_key: str | None = None, matches: DataFrame | None = None) -> DataFrame:
        src, tgt = self._target_key(matches, tgt_key)
        t, s, _ = self._keyed(tgt, src)
        return row_match.preview(t, s, self.options.equality_first)

    def source_keys(self, tgt_key: str | None = None, matches: DataFrame | None = None) -> DataFrame:
        """The sources' keys (src_key, ord), each once, in the order of sources and rows: what a user may choose instead of what was aligned."""
        src, tgt = self._target_key(matches, tgt_key)
        _, s, _ = self._keyed(tgt, src)
        place = F.create_map(*[x for o in self.sources for x in (F.lit(o.source_id), F.lit(o.order))])
        first = s.groupBy("src_key").agg(F.min(F.struct(F.element_at(place, F.col("source_id")).alias("o"), "s_ord")).alias("_at"))
        return keys.numbered(first, "_at").select("src_key", F.col("_rank").alias("ord"))

    def _source_of(self, match) -> Source | None:
        """The one source that a match draws on: file and sheet as named, else the file's name, else the last with such a column."""
        file, sheet = match["src_file"] or "", match["src_sheet"] or ""
        base = os.path.basename(file)
        exact = [x for x in self.sources if (x.file, x.sheet) == (file, sheet)]
        alike = [x for x in self.sources if base and os.path.basename(x.file) == base and sheet in ("", x.sheet)]
        if exact or alike:
            return (exact or alike)[0]
        return next((x for x in reversed(self.sources) if self._resolve(x.table.columns, match["src_field"], match["tgt_field"])), None)

    # --- filling ---

    def fill(self, matches: DataFrame, tgt_key: str | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The filled target and its statistics."""
        src_key, key = self._target_key(matches, tgt_key)
        t, s, key_of = self._keyed(key, src_key)
        if t.isEmpty():  # an empty template takes its rows from the sources' keys
            first = s.groupBy(F.col("src_key").alias("key")).agg(F.min("s_ord").alias("ord"))
            led = row_match.leaders(first.select("ord", "key")).where("leader = ord").select("key", "ord")
            self.target.table = kept(keys.expand_target(self.target.table.where(text.valid(F.col(f"`{key}`"))), led, key, "row_idx"), "target")
            t, s, key_of = self._keyed(key, src_key)
        aligned = row_match.align_keys(t, s, self.options.equality_first).select("source_id", "tgt_key", "src_key")
        own = t.select("tgt_key", F.explode(F.array(*[F.lit(x.source_id) for x in self.sources])).alias("source_id"))
        effective = fill.effective_keys(own, aligned, overrides, self.options.unbind)
        picked, lost = [], []
        for r in matches.where(F.col("matched") & F.col("src_field").isNotNull()).collect():  # a row for each column of the template
            source = self._source_of(r)
            column = self._resolve(source.table.columns, r["src_field"], r["tgt_field"]) if source else None
            if column:
                picked.append((r["tgt_field"], column, source.source_id))
            else:
                lost.append((r["tgt_field"], "skip", 0, "no source has this field"))
        table = self.spark.createDataFrame(picked, "tgt_field string, src_field string, source_id string")
        missing = self.spark.createDataFrame(lost, "tgt_field string, status string, cells long, reason string")
        cells = None
        for x in self.sources:
            fields = sorted({f for _, f, i in picked if i == x.source_id})
            if fields:
                filled = keys.forward_fill(x.table, key_of[x.source_id], "row_idx")
                part = fill.source_cells(filled, x.source_id, x.order, key_of[x.source_id], "row_idx", fields)
                cells = part if cells is None else cells.unionByName(part)
        if cells is None:
            return self.target.table, missing
        table, stats = fill.fill(self.target.table, key, "row_idx", cells, effective, table, self.options.policy)
        return table, stats.unionByName(missing)

    def _write(self, table: DataFrame, output: str) -> dict:
        """The filled target as a copy of its workbook, as a new workbook for other targets, or as Parquet for any other ``output``."""
        if not output.lower().endswith(".xlsx"):
            table.write.mode("overwrite").parquet(output)
            return {"output_path": output}
        names = self.target_fields()
        if table.count() > SHEET_ROWS:
            raise ValueError("a sheet can't hold so many rows; write Parquet instead")
        rows = [tuple(r) for r in table.select("row_idx", *[F.col(f"`{n}`") for n in names]).orderBy("row_idx").collect()]  # a template's rows
        if not self.target.path_is_workbook:
            sink.publish(sink.new_workbook(names, [list(r[1:]) for r in rows]), output)
            return {"output_path": output, "note": "the target is no workbook; a plain one was written"}
        with open(self.target.file, "rb") as f:
            content, skipped = sink.filled_workbook(f.read(), self.target.sheet, names, rows, self.target.header)
        sink.publish(content, output)
        return {"output_path": output} | ({"note": f"not in the template's header: {', '.join(skipped)}"} if skipped else {})

    def execute(self, matches: DataFrame, output: str, tgt_key: str | None = None, overrides: DataFrame | None = None, log: str | None = None) -> threading.Thread:
        """Fills and writes the target in the background; ``status`` tells how far it is, ``abort`` ends it."""
        self._tag = f"fill-{uuid.uuid4().hex}"
        self.status = {"running": True, "pct": 0.0, "msg": "filling", "done": False, "aborted": False, "error": None, "result": None}

        def work() -> None:
            began = time.time()
            self.spark.addTag(self._tag)
            self.spark.sparkContext.addJobTag(self._tag)  # the session's own tags can't be asked for their jobs
            try:
                if log:
                    sink.log_start(self.spark, log, matches, output)
                    sink.log_matches(matches, log)
                self.status["msg"] = "aligning"
                table, stats = self.fill(matches, tgt_key, overrides)
                self.status["msg"] = "filling"
                table = kept(table, "filled")
                if self.status["aborted"]:
                    raise TimeoutError("aborted before anything was written")
                self.status["msg"] = "writing"
                written = self._write(table, output)
                details = [r.asDict() for r in stats.collect()]
                if log:
                    sink.log_summary(matches, log, time.time() - began)
                self._jobs = max(1, self.progress()["jobs"])
                self.status |= {"pct": 100.0, "done": True, "msg": "done", "result": {"filled": sum(r["cells"] for r in details), "details": details} | written}
            except Exception as e:  # noqa: BLE001  the caller asks for the status
                self.status |= {"error": str(e)}
            finally:
                self.status["running"] = False
                self.spark.removeTag(self._tag)
                self.spark.sparkContext.removeJobTag(self._tag)

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        return thread

    def progress(self) -> dict:
        """The status, with its share done brought up to date, and the run's jobs and tasks so far.

        Spark's own counts tell how far the jobs of the run are; how many there will be is taken from the last run of the session,
        and if it was more, the share grows more slowly. It never falls, and reaches 100 only when the result is written.
        """
        tracker = self.spark.sparkContext.statusTracker()
        jobs = self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self._tag) if self._tag else []
        done, tasks, over = 0.0, 0, 0
        for info in filter(None, map(tracker.getJobInfo, jobs)):
            stages = [s for s in map(tracker.getStageInfo, info.stageIds) if s]
            every, complete = sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages)
            tasks += complete
            over += info.status == "SUCCEEDED"
            done += 1.0 if info.status == "SUCCEEDED" else complete / every if every else 0.0
        if self.status["running"]:
            share = 95.0 * done / max(self._jobs, len(jobs) + 1)
            self.status["pct"] = max(self.status["pct"], round(share, 1))
        return self.status | {"jobs": len(jobs), "jobs_done": over, "tasks_done": tasks}

    def abort(self) -> None:
        self.status |= {"aborted": True}
        self.spark.interruptTag(self._tag)
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def path_exists(self, path: str) -> bool:
        return os.path.exists(path)


