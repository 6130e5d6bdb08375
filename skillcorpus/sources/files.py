"""Skill files and reports in folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# File patterns of the agent tools (source, path pattern), most specific first; extensions of bundle files.
MATCHERS = [
    ("Codex", r"(?i)/\.codex/skills/(?:.*/)?(?:skill\.md|[^/]+\.skill\.md)$"), ("Claude Code", r"(?i)/\.claude/(?:skills|plugins)/(?:.*/)?(?:skill\.md|[^/]+\.skill\.md)$"),
    ("Cursor · rules", r"(?i)/\.cursor/rules/(?:.*/)?[^/]+\.mdc$"), ("Cursor · .cursorrules", r"(?i)/\.cursorrules$"), ("Copilot · instructions", r"(?i)/\.github/(?:copilot-instructions\.md|instructions/(?:.*/)?[^/]+\.instructions\.md)$"),
    ("Cline · rules", r"(?i)/(?:\.clinerules|Cline/Rules)(?:/(?:.*/)?[^/]+\.md)?$"), ("Windsurf · rules", r"(?i)/\.windsurf/rules/(?:.*/)?[^/]+\.md$"), ("Windsurf · .windsurfrules", r"(?i)/\.windsurfrules$"),
    ("Skills folder", r"(?i)/(?:skill\.md|[^/]+\.skill\.md)$"),
]
SKIPPED = r"(?i)/(?:node_modules|dist|build|out|vendor|venv|\.venv|__pycache__|\.git|\.cache)/"
SCRIPTS = {"sh": "bash", "bash": "bash", "zsh": "bash", "py": "python", "python": "python", "python3": "python", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "rb": "ruby", "pl": "perl", "ps1": "powershell", "php": "php"}
TEXTS = ["md", "markdown", "mdx", "txt", "rst"]


# Where agent tools keep their files, below a home or project folder.
ROOTS = [".claude/skills", ".claude/plugins", ".codex/skills", ".cursor/rules", ".cursorrules", ".github/copilot-instructions.md", ".github/instructions", ".clinerules", "Documents/Cline/Rules", ".windsurf/rules", ".windsurfrules"]


def read_files(spark: SparkSession, base: str) -> DataFrame:
    """``path, size, content`` of all files in the agent tools' folders below ``base`` (a folder, or a pattern of folders).

    Spark's file listing passes over hidden folders unless a path names them, so each is named.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    wanted = []
    for root in ROOTS:
        at = hadoop(f"{base.rstrip('/')}/{root}")
        if at.getFileSystem(conf).globStatus(at):
            wanted.append(f"{base.rstrip('/')}/{root}")
    if not wanted:
        return spark.createDataFrame([], "path string, size long, content binary")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted)
    return rows.select("path", F.col("length").alias("size"), "content")


def source_of(path: Column) -> Column:
    out = None
    for name, pattern in MATCHERS:
        cond = F.rlike(path, F.lit(pattern))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(~F.rlike(path, F.lit(SKIPPED)), out)


def skill_name(path: Column, md: Column) -> Column:
    """A skill's name: its folder, the stem of its file, or what its frontmatter says."""
    base, parent = F.element_at(F.split(path, "/"), -1), F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    low = F.lower(base)
    said = F.trim(F.regexp_extract(F.coalesce(md, F.lit("")), r"""(?im)^\s*name\s*:\s*["']?([^"'\n]+)["']?""", 1))
    return (
        F.when(low.isin(".cursorrules", ".windsurfrules", ".clinerules"), low).when(low == "copilot-instructions.md", "copilot-instructions").when(low.endswith(".skill.md"), F.regexp_replace(base, r"(?i)\.skill\.md$", ""))
        .when((low == "skill.md") & (parent != "") & (F.lower(parent) != "skills"), parent).when(said != "", said).otherwise(F.regexp_replace(base, r"(?i)(?:\.instructions\.md|\.mdc|\.md)$", ""))
    )


def discover(files: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None, max_total_bytes: int | None = None, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Skill files among ``files`` (``portfolio_id, path, size, md``), and one row per place: ``portfolio_id, source, n, truncated``.

    A file counts once per path. Limits are off unless given; what they leave out sets ``truncated``. Files more than ``depth``
    folders below their root are not looked at.
    """
    rows = files.withColumn("source", source_of(F.col("path"))).filter("source is not null").dropDuplicates(["portfolio_id", "path"])
    below = F.regexp_replace("path", r"(?i)^.*?/(?:skills|plugins|rules|instructions|\.clinerules)/", "")
    rows = rows.filter(F.size(F.split(below, "/")) <= depth + 1)
    order = Window.partitionBy("portfolio_id", "source").orderBy("path")
    small = F.lit(True) if max_file_bytes is None else F.col("size") <= max_file_bytes
    rows = rows.withColumn("small", small)
    before = F.coalesce(F.sum(F.when(F.col("small"), F.col("size")).otherwise(0)).over(Window.partitionBy("portfolio_id").orderBy("source", "path").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    fits = F.col("small") & (F.lit(True) if max_total_bytes is None else before <= max_total_bytes)
    rows = rows.withColumn("fits", fits & (F.lit(True) if max_files is None else F.row_number().over(order) <= max_files))
    places = rows.groupBy("portfolio_id", "source").agg(F.count_if("fits").alias("n"), (~F.bool_and("fits")).alias("truncated"))
    return rows.filter("fits").withColumn("name", skill_name(F.col("path"), F.col("md"))).drop("small", "fits"), places


def bundles(skills: DataFrame, files: DataFrame, max_file: int = 64_000, max_files: int = 40, max_total: int = 200_000) -> DataFrame:
    """``portfolio_id, skill_path, bundle_text, bundle_files, complete, issues``: text and script files below each skill's folder.

    ``skills`` has ``portfolio_id, path``; ``files`` has ``portfolio_id, path, size, md`` (their text). Files are taken by path. One over
    ``max_file`` bytes is left out, as is one with which the total would pass ``max_total``, and smaller ones after it may
    still fit; each such case is an issue, and the bundle then not complete. Scripts stand in a fence of their language.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    eligible = files.withColumn("ext", ext).filter(F.col("ext").isin(*SCRIPTS, *TEXTS) & ~F.lower("path").endswith("/skill.md") & ~F.lower("path").endswith(".skill.md"))
    up = F.split(folder, "/")
    eligible = eligible.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))))
    roots = skills.select("portfolio_id", F.col("path").alias("skill_path"), folder.alias("folder"))
    lang = F.create_map(*[x for k, v in SCRIPTS.items() for x in (F.lit(k), F.lit(v))])
    text = F.when(F.col("ext").isin(*SCRIPTS), F.concat(F.lit("```"), lang[F.col("ext")], F.lit("\n"), F.col("md"), F.lit("\n```"))).otherwise(F.col("md"))
    inside = roots.join(eligible.select("portfolio_id", "folder", F.expr("substring(path, length(folder) + 2)").alias("file"), "size", text.alias("text")), ["portfolio_id", "folder"], "left")
    listed = inside.groupBy("portfolio_id", "skill_path").agg(F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("file", "size", "text")))).alias("all"))
    state = "struct<n:bigint,total:bigint,files:array<string>,texts:array<string>,issues:array<string>>"
    begin = F.from_json(F.lit('{"n":0,"total":0,"files":[],"texts":[],"issues":[]}'), state)

    def make(s: Column, keep: Column, f: Column, issue: Column) -> Column:
        return F.struct(
            F.when(keep, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(keep, s["total"] + f["size"]).otherwise(s["total"]).alias("total"), F.when(keep, F.concat(s["files"], F.array(f["file"]))).otherwise(s["files"]).alias("files"),
            F.when(keep, F.concat(s["texts"], F.array(f["text"]))).otherwise(s["texts"]).alias("texts"), F.when(keep | F.array_contains(s["issues"], issue), s["issues"]).otherwise(F.concat(s["issues"], F.array(issue))).alias("issues"),
        )

    def step(s: Column, f: Column) -> Column:
        issue = (
            F.when(s["n"] >= max_files, F.lit(f"more than {max_files} files")).when(f["size"] > max_file, F.concat(F.lit(f"file over {max_file} bytes: "), f["file"])).when(s["total"] + f["size"] > max_total, F.lit(f"more than {max_total} bytes"))
        )
        return make(s, issue.isNull(), f, F.coalesce(issue, F.lit("")))

    done = listed.withColumn("s", F.aggregate("all", begin, lambda s, f: step(s, f).cast(state)))
    return done.select("portfolio_id", "skill_path", F.array_join("s.texts", "\n\n").alias("bundle_text"), F.col("s.files").alias("bundle_files"), (F.size("s.issues") == 0).alias("complete"), F.col("s.issues").alias("issues"))


def write_scan(parts: dict[str, DataFrame], folder: str) -> str:
    """Writes the parts of a scan (``skills``, ``conflicts``, …) as JSON, each with a folder per portfolio; returns where."""
    path = f"{folder.rstrip('/')}/scan-{uuid.uuid4().hex}"
    for name, rows in parts.items():
        rows.write.partitionBy("portfolio_id").json(f"{path}/{name}")
    return path


def read_scan(spark: SparkSession, path: str, part: str, schema: StructType) -> DataFrame:
    """A part of a written scan. A part without rows has no folder of a portfolio, and reads as empty."""
    return spark.read.schema(schema).json(f"{path}/{part}")


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a folder; a record that does not parse has its text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
