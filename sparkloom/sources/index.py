"""The index of a source tree: tables of files, types, members, events and edges, in versions."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import code_words
from ..functions.text import is_generated, is_test
from ..operators.relations import copied_forward, delta, recent_notes, with_precedence
from . import csharp, scss, tree, typescript

_MEMBER = "struct<name:string,kind:string,return_type:string,signature:string,start_line:int,line_count:int>"
_TYPE = f"struct<name:string,kind:string,keyword:string,base_types:array<string>,start_line:int,line_count:int,is_nested:boolean,enum_values:string,namespace:string,members:array<{_MEMBER}>>"
_EVENT = "struct<kind:string,line:int,name:string,text:string,enclosing_type:string,enclosing_member:string,is_access:boolean,receiver:string,is_empty:boolean,in_finally:boolean,is_public:boolean,is_fixed:boolean>"
_WIRE = "struct<kind:string,service:string,impl:string,lifetime:string,start_line:int,confidence:string,enclosing_type:string,enclosing_member:string,conditional:boolean>"
_IMPORT, _USE = "struct<name:string,module:string,line:int>", "struct<name:string,line:int>"
SCHEMA = (
    "path string, name string, project string, project_dir string, lang string, mtime timestamp, text string, namespace string, usings array<string>, aliases map<string,string>, "
    f"types array<{_TYPE}>, events array<{_EVENT}>, registrations array<{_WIRE}>, imports array<{_IMPORT}>, uses array<{_USE}>, words map<string,int>"
)
#: The languages of each part of an index.
SEGMENTS = {"cs": ["cs"], "ts": ["ts", "scss"]}
_PARSERS = {"cs": csharp.parse, "ts": typescript.parse, "scss": scss.parse}
VERSION = 2


def parsed(files: DataFrame) -> DataFrame:
    """Files (path, name, project, project_dir, lang, mtime, content) as rows of SCHEMA. What can't
    be parsed stays as a file without types."""
    fields = [f.name for f in files.sparkSession.createDataFrame([], SCHEMA).schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(files.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row.pop("content") or ""
                try:
                    got = _PARSERS[row["lang"]](text)
                except (IndexError, RecursionError):
                    got = {}
                out = dict.fromkeys(fields) | row | {"text": text}
                out["words"] = list(code_words(text).items())
                out |= {"namespace": got.get("namespace"), "usings": got.get("usings", []), "aliases": list(got.get("aliases", {}).items()), "types": got.get("types", [])}
                out |= {"events": got.get("events", []), "registrations": got.get("registrations", []), "imports": got.get("imports", []), "uses": [{"name": k, "line": v} for k, v in got.get("uses", {}).items()]}
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, target)

    return files.select("path", "name", "project", "project_dir", "lang", "mtime", "content").mapInArrow(run, SCHEMA)


@dataclass
class Index:
    """One immutable version: `files` holds everything parsed, `projects` and `references` the rest."""

    files: DataFrame
    projects: DataFrame
    references: DataFrame

    @property
    def types(self) -> DataFrame:
        return self.files.select("project", "path", F.col("name").alias("file"), "lang", F.posexplode("types").alias("type_no", "t")).select(
            "project", "path", "file", "lang", "type_no", "t.name", "t.kind", "t.keyword", "t.base_types", "t.start_line", "t.line_count", "t.is_nested", "t.enum_values", "t.namespace", "t.members"
        )

    @property
    def members(self) -> DataFrame:
        rows = self.types.select("project", "path", "file", "lang", "type_no", F.col("name").alias("parent_type"), "namespace", F.posexplode("members").alias("member_no", "m"))
        return rows.select("project", "path", "file", "lang", "type_no", "member_no", "parent_type", "namespace", "m.name", "m.kind", "m.return_type", "m.signature", "m.start_line", "m.line_count")

    @property
    def symbols(self) -> DataFrame:
        columns = ["name", "kind", "project", "file", "path", "start_line", "line_count", "namespace", "signature", "parent_type"]
        types = self.types.withColumn("signature", F.lit(None).cast("string")).withColumn("parent_type", F.lit(None).cast("string"))
        return types.select(*columns).unionByName(self.members.select(*columns))

    @property
    def events(self) -> DataFrame:
        return self.files.select("project", "path", F.col("name").alias("file"), "lang", F.explode("events").alias("e")).select("project", "path", "file", "lang", "e.*")

    @property
    def registrations(self) -> DataFrame:
        return self.files.select("project", "path", F.explode("registrations").alias("r")).select("project", "path", "r.*")

    @property
    def texts(self) -> DataFrame:
        """Files with their facet: generated, test or neither."""
        below = F.substring("path", F.length("project_dir") + 1, 1 << 30)
        return self.files.select("project", "path", F.col("name").alias("file"), "lang", "text", is_generated(F.col("name")).alias("generated"), is_test(F.col("project"), F.col("name"), below).alias("test"))


def listed(files: DataFrame, loose: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files to index with their projects and languages, and all projects; a C# project comes
    before a TypeScript one of the same name."""
    cs, ts = tree.solution_projects(files, loose), tree.ts_projects(files)
    mine = tree.assigned_cs(files, cs).withColumn("lang", F.lit("cs"))
    theirs = tree.assigned_ts(files, ts).withColumn("lang", F.when(F.col("ext") == "scss", "scss").otherwise("ts"))
    projects = with_precedence(cs.select("name", "dir", F.lit("cs").alias("segment")), ts.select("name", "dir", F.lit("ts").alias("segment")), "name")
    return mine.unionByName(theirs), projects


def _states(before: DataFrame, wanted: DataFrame) -> DataFrame:
    return delta(before.select("path", "mtime"), wanted.select("path", "mtime"), "path", "mtime")


def build(files: DataFrame, loose: bool = False, before: Index | None = None, segment: str | None = None, full: bool = False) -> Index:
    """The index of a tree (`tree.scan`); with an earlier version only new and changed files are
    parsed, the others are taken over.

    With a segment ('cs', or 'ts' with its style sheets) its files, projects and references are
    brought up to date (all its files are parsed if `full`); those of the other one stay as they were.
    """
    wanted, projects = listed(files, loose)
    references = tree.project_references(files)
    if before is None:
        return Index(parsed(wanted), projects, references)
    had, others = before.files, None
    if segment:
        wanted, had, others = wanted.filter(F.col("lang").isin(SEGMENTS[segment])), had.filter(F.col("lang").isin(SEGMENTS[segment])), had.filter(~F.col("lang").isin(SEGMENTS[segment]))
        own, theirs = projects.filter(F.col("segment") == segment), before.projects.filter(F.col("segment") != segment)
        projects = with_precedence(own, theirs, "name") if segment == "cs" else with_precedence(theirs, own, "name")
        references = references if segment == "cs" else before.references
    if full:
        out = parsed(wanted)
    else:
        states = _states(had, wanted)
        fresh = parsed(wanted.join(states.filter("state IN ('added', 'changed')").select("path"), "path", "left_semi"))
        out = copied_forward(had, states, "path", fresh)
    return Index(out if others is None else out.unionByName(others), projects, references)


class Store:
    """Versions of an index in a folder. Readers hold one; a new one is published by replacing a
    small pointer file, so that they never see half of it."""

    TABLES = ("files", "projects", "references")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, index: Index, kind: str = "full") -> str:
        begun, version = time.time(), f"v{VERSION}-{uuid.uuid4().hex[:12]}"
        for name in self.TABLES:
            getattr(index, name).write.parquet(f"{self.folder}/{version}/{name}")
        entry = {"schema": VERSION, "version": version, "when": time.time(), "kind": kind, "seconds": round(time.time() - begun, 3)}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/.next-{version}")
        files = self._fs.globStatus(self._path(f"{self.folder}/.next-{version}/part-*"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = gateway.new_array(option, 1)
        overwrite[0] = option.OVERWRITE
        context.rename(files[0].getPath(), self._path(f"{self.folder}/CURRENT"), overwrite)
        self._fs.delete(self._path(f"{self.folder}/.next-{version}"), True)
        return version

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def info(self) -> dict | None:
        """The published version's entry; None if there is none or its schema is another."""
        if not self.exists(f"{self.folder}/CURRENT"):
            return None
        try:
            entry = json.loads(self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None
        return entry if entry.get("schema") == VERSION else None

    def current(self) -> Index | None:
        entry = self.info()
        if entry is None:
            return None
        at = f"{self.folder}/{entry['version']}"
        return Index(*(self.spark.read.parquet(f"{at}/{name}") for name in self.TABLES))

    def refresh(self, files: DataFrame, full: bool = False, loose: bool = False, segment: str | None = None) -> bool:
        """Publishes the tree's state; False if nothing has changed. With a segment only that one is
        compared and read again; without an earlier version both are built."""
        before = None if full and not segment else self.current()
        if before is not None and not full:
            (wanted, _), had = listed(files, loose), before.files
            if segment:
                wanted, had = (x.filter(F.col("lang").isin(SEGMENTS[segment])) for x in (wanted, had))
            if not _states(had, wanted).filter("state <> 'same'").limit(1).count():
                return False
        self.publish(build(files, loose, before, segment, full), "full" if before is None or full else "delta")
        return True

    def vacuum(self, older_than: float = 1800) -> list[str]:
        """Drops versions that aren't current and were not written in the last half hour."""
        entry = self.info()
        gone = []
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith(f"v{VERSION}-") and (not entry or name != entry["version"]) and status.getModificationTime() / 1000 < time.time() - older_than:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone


class Notes:
    """Short notes beside a store: appended, read back without repeats, newest first."""

    def __init__(self, store: Store):
        self.spark, self.folder = store.spark, f"{store.folder}/notes"

    def remember(self, note: str) -> None:
        row = [(time.time_ns(), note)]
        self.spark.createDataFrame(row, "seq long, note string").coalesce(1).write.mode("append").parquet(self.folder)

    def recent(self, most: int = 50) -> DataFrame:
        try:
            notes = self.spark.read.schema("seq long, note string").parquet(self.folder)
        except AnalysisException:
            notes = self.spark.createDataFrame([], "seq long, note string")
        return recent_notes(notes, most)
