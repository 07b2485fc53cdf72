"""Source trees: listing, projects, and which project a file belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scalars import first_of

#: Folders that are never part of a tree (fixed values).
SKIPPED = ["node_modules", "bin", "obj", ".git", ".vs", ".sparkloom"]
TS_SKIPPED = [*SKIPPED, "dist", ".next"]
TS_EXTENSIONS = ["ts", "tsx", "mts", "cts"]


#: Names of the files that an index can use; no other is read.
WANTED = ["*.cs", "*.csproj", "*.sln", "*.slnx", "*.dbml", *(f"*.{x}" for x in TS_EXTENSIONS), "*.scss", "tsconfig.json", "package.json"]


def folders(spark: SparkSession, root: str, also_skipped: tuple[str, ...] = ()) -> list[str]:
    """The folders of a tree that hold files; skipped ones are never listed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, skipped = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {*SKIPPED, *map(str.lower, also_skipped)}
    out, stack = [], [at]
    while stack:
        here, holds = stack.pop(), False
        for status in files.listStatus(here):
            if not status.isDirectory():
                holds = True
            elif status.getPath().getName().lower() not in skipped and not status.isSymlink():
                stack.append(status.getPath())
        if holds:
            out.append(here.toString())
    return sorted(out)


def scan(spark: SparkSession, root: str, also_skipped: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to root), name, dir, ext, mtime, content of the files outside skipped folders that
    an index can use. Skipped folders and other files are neither listed nor read; the content is read only
    where a query selects it."""
    any_case = "{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name) for name in WANTED) + "}"
    schema = "path string, modificationTime timestamp, length long, content binary"
    held = folders(spark, root, also_skipped)
    files = spark.read.format("binaryFile").option("pathGlobFilter", any_case).load(held) if held else spark.createDataFrame([], schema)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.substring(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), len(base) + 2, 1 << 30)
    return tree(files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), "content"), also_skipped)


def tree(files: DataFrame, also_skipped: tuple[str, ...] = ()) -> DataFrame:
    """The same from rows of path, mtime and content (binary or text)."""
    norm = F.replace("path", F.lit("\\"), F.lit("/"))
    out = files.select(norm.alias("path"), "mtime", F.col("content").cast("string").alias("content"))
    out = out.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return out.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).filter(~_within("dir", [*SKIPPED, *map(str.lower, also_skipped)]))


def _within(folder: str, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.col(folder)), "/"), F.array(*map(F.lit, names)))


def _ancestors(folder: Column) -> Column:
    """a/b -> ['', 'a', 'a/b']."""

    def of(parts):
        return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))

    return F.array_distinct(F.element_at(F.transform(F.array(F.split(folder, "/")), of), 1))


def _joined(folder: Column, relative: Column) -> Column:
    """folder/relative with `..` and `.` resolved."""
    parts = F.split(F.concat_ws("/", F.when(folder != "", folder), F.replace(relative, F.lit("\\"), F.lit("/"))), "/")
    step = lambda acc, p: F.when(p.isin(".", ""), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def solution_projects(files: DataFrame, loose: bool = False) -> DataFrame:
    """name, dir, csproj: projects that a solution names and the tree holds, one for each folder;
    `.sln` files come before `.slnx` ones. `loose` adds the projects that no solution names."""
    sln = F.regexp_extract_all("content", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'), 1)
    slnx = F.regexp_extract_all("content", F.lit(r'<Project\s[^>]*Path\s*=\s*"([^"]+\.csproj)"'), 1)
    named = files.filter(F.col("ext").isin("sln", "slnx"))
    named = named.select("path", "dir", (F.col("ext") == "slnx").alias("late"), F.posexplode(F.when(F.col("ext") == "sln", sln).otherwise(slnx)).alias("pos", "relative"))
    named = named.select("late", "path", "pos", F.lower(_joined(F.col("dir"), F.col("relative"))).alias("key"))
    here = files.filter("ext = 'csproj'").select(F.col("path").alias("csproj"), "dir", F.regexp_replace("name", r"(?i)\.csproj$", "").alias("name"), F.lower("path").alias("key"))
    met = here.join(named, "key", "left" if loose else "inner").withColumn("late", F.coalesce(F.col("late").cast("int"), F.lit(2)))
    return first_of(met, [F.lower("dir")], ["late", "path", "pos", "csproj"]).select("name", "dir", "csproj")


def assigned_cs(files: DataFrame, projects: DataFrame) -> DataFrame:
    """C# files with the project of their deepest folder that holds a csproj; none if that is no
    project of a solution. X.designer.cs counts only beside X.dbml."""
    cs = files.filter("ext = 'cs'")
    model = files.filter("ext = 'dbml'").select(F.lower(F.regexp_replace("path", r"(?i)\.dbml$", "")).alias("_model")).distinct()
    designed = F.lower("name").endswith(".designer.cs")
    cs = cs.filter(~designed).unionByName(cs.filter(designed).join(model, F.lower(F.regexp_replace("path", r"(?i)\.designer\.cs$", "")) == F.col("_model"), "left_semi"))
    return _deepest(cs, files.filter("ext = 'csproj'").select("dir").distinct(), projects).filter("project IS NOT NULL")


def _deepest(files: DataFrame, boundaries: DataFrame, projects: DataFrame) -> DataFrame:
    chain = files.select("path", F.posexplode(_ancestors(F.col("dir"))).alias("depth", "up"))
    found = chain.join(boundaries.select(F.lower("dir").alias("_dir")).distinct(), F.lower("up") == F.col("_dir")).groupBy("path").agg(F.max_by("up", "depth").alias("project_dir"))
    named = projects.select(F.col("name").alias("project"), F.lower("dir").alias("_key"))
    owned = found.join(named, F.lower("project_dir") == F.col("_key"), "left").drop("_key")
    return files.join(owned, "path", "left")


def _uncommented(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/|(?m)(?<![:\"])//[^\n]*$", ""), r",(\s*[}\]])", "$1")


def ts_projects(files: DataFrame) -> DataFrame:
    """name, dir of the folders that hold a tsconfig.json or package.json, named by the package or
    the folder; equal names (in any case) get their folder in brackets."""
    configs = files.filter(F.lower("name").isin("tsconfig.json", "package.json") & ~_within("dir", TS_SKIPPED))
    package = F.when(F.lower(F.col("name")) == "package.json", F.get_json_object(_uncommented(F.col("content")), "$.name"))
    found = configs.groupBy("dir").agg(F.max(package).alias("package"))
    name = F.coalesce(F.when(F.trim("package") != "", F.col("package")), F.when(F.col("dir") == "", "root").otherwise(F.element_at(F.split("dir", "/"), -1)))
    named = found.select(name.alias("name"), "dir")
    twice = F.count("*").over(Window.partitionBy(F.lower("name"))) > 1
    return named.select(F.when(twice, F.concat("name", F.lit(" ["), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit("]"))).otherwise(F.col("name")).alias("name"), "dir")


def path_aliases(files: DataFrame) -> DataFrame:
    """alias, targets of compilerOptions.paths; of equal aliases the last file's, in order of paths."""
    paths = F.from_json(F.get_json_object(_uncommented(F.col("content")), "$.compilerOptions.paths"), "map<string,array<string>>")
    rows = files.filter(F.lower("name") == "tsconfig.json").select("path", F.explode(paths).alias("alias", "targets"))
    return rows.groupBy("alias").agg(F.max_by("targets", "path").alias("targets"))


def assigned_ts(files: DataFrame, projects: DataFrame) -> DataFrame:
    """TypeScript and SCSS files with the project of their nearest boundary, or a made-up one."""
    ts = files.filter(F.col("ext").isin(*TS_EXTENSIONS, "scss") & ~_within("dir", TS_SKIPPED))
    owned = _deepest(ts, projects.select("dir"), projects)
    orphan = F.concat(F.when(F.col("ext") == "scss", "scss:").otherwise("ts:"), F.coalesce(F.nullif(F.element_at(F.split("dir", "/"), -1), F.lit("")), F.lit("root")))
    return owned.withColumn("project", F.coalesce("project", orphan)).withColumn("project_dir", F.coalesce("project_dir", "dir"))


def project_references(files: DataFrame) -> DataFrame:
    """src, dst: a project file's references to others, by name."""
    refs = F.regexp_extract_all("content", F.lit(r'<ProjectReference\s+Include\s*=\s*"([^"]+)"'), 1)
    rows = files.filter("ext = 'csproj'").select(F.regexp_replace("name", r"(?i)\.csproj$", "").alias("src"), F.explode(refs).alias("target"))
    return rows.select("src", F.regexp_replace(F.element_at(F.split(F.replace("target", F.lit("\\"), F.lit("/")), "/"), -1), r"(?i)\.csproj$", "").alias("dst")).distinct()
