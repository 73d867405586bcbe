"""Sources: tables, repository files, markdown, JSON, JSON lines, event streams, git logs."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import schemas
from weftline.functions import paths, text, tokens
from weftline.operators import graph

#: Extensions of source files and of documents.
SOURCE_EXTENSIONS = [".cs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".rs", ".rb"]
DOC_EXTENSIONS = [".md", ".txt", ".rst", ".json", ".yaml", ".yml"]
#: Folders that the source loader leaves out.
SOURCE_SKIP_DIRS = ["node_modules", "bin", "obj", r"\.git", "dist", "vendor"]
#: Well-known documents in the order in which they are wanted.
KNOWN_DOCS = ["readme.md", "architecture.md", "contributing.md", "changelog.md"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-01: a Parquet table of a folder, whatever the store."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """SRC-01: a table of a live database; with a numeric key and its bounds, read in so many ranges."""
    if key and bounds:
        return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
    return spark.read.jdbc(url, name, properties=options)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """SRC-02: the row of a key, or none. The filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def repository(spark: SparkSession, root: str, glob: str | None = None, skip: Callable[[str], Column] = paths.skipped) -> DataFrame:
    """SRC-03, FLT-10: (file_path, size_bytes, raw): files under a folder but those that one of the three skip rules leaves out; paths relative to the folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    prefix = re.sub(r"^[a-z]+://", "", root).rstrip("/") + "/"
    relative = F.substring_index(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/"), prefix, -1)
    out = files.select(relative.alias("file_path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    return out.where(~F.coalesce(skip("file_path"), F.lit(True)))


def content(files: DataFrame, longest: int | None = None) -> DataFrame:
    """The files' text, whole or cut to a length; bytes that are no UTF-8 become replacement characters."""
    text = F.decode("raw", "UTF-8")
    return files.withColumn("content", F.left(text, F.lit(longest)) if longest else text).drop("raw")


def index(files: DataFrame, analysing: bool = False) -> DataFrame:
    """SRC-03, STR-14 to STR-18: one row a file with module, type, language, importance, entry point, by the rules of the structure index or of the analysing one."""
    p = F.col("file_path")
    if analysing:
        columns = {"module_name": paths.module_second(p), "file_type": paths.file_type_analysis(p), "language": paths.language(p, "index"), "importance_score": paths.importance_analysis(p)}
        rows = files.select("file_path", "size_bytes", *[c.alias(k) for k, c in columns.items()])
        best = top_scored(rows).select("file_path", F.lit(True).alias("_entry"))
        return rows.join(best, "file_path", "left").withColumn("is_entry_point", F.coalesce("_entry", F.lit(False))).drop("_entry")
    columns = {"module_name": paths.module_first(p), "file_type": paths.file_type(p), "language": paths.language(p, "index"), "importance_score": paths.importance(p), "is_entry_point": paths.is_entry_point(p)}
    return files.select("file_path", "size_bytes", *[c.alias(k) for k, c in columns.items()])


def top_scored(rows: DataFrame, least: int = 8, most: int = 10) -> DataFrame:
    """STR-18, fixed values 8 and 10: the source and configuration files of highest importance, at which programs are taken to start."""
    return rows.where(F.col("file_type").isin("source", "config") & (F.col("importance_score") >= least)).orderBy(F.col("importance_score").desc(), "file_path").limit(most)


def technology(files: DataFrame) -> DataFrame:
    """STR-19, the structure index: one row (project, technology) of the last path that points to one; unknown ones are null."""
    d = files.select("file_path", paths.detected("file_path").alias("d")).where("d is not null")
    return d.agg(F.max_by("d", "file_path").alias("d")).select("d.project", "d.technology")


def source_files(files: DataFrame, most: int = 500) -> DataFrame:
    """SRC-04, LIM-05: the first source files in path order, outside of six folders, each cut; both limits and the list are the rule's own."""
    inside = F.coalesce(~F.col("file_path").rlike("|".join(f"{d}/" for d in SOURCE_SKIP_DIRS)), F.lit(False))
    return content(files.where(paths.extension("file_path").isin(SOURCE_EXTENSIONS) & inside), 50_000).orderBy("file_path").limit(most)


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05: project files by name; other files are never opened."""
    return content(repository(spark, root, "{*.csproj,*.sln,package.json}"))


def corpus(files: DataFrame, most_code: int = 81_920, most_doc: int = 8_192) -> DataFrame:
    """SRC-06: code and documents within their token limits."""
    c = content(files.where(~F.coalesce(paths.skipped_document("file_path"), F.lit(True))))
    ext = paths.extension("file_path")
    c = c.withColumns({"is_code": ext.isin(SOURCE_EXTENSIONS), "token_count": tokens.estimate("content")}).where(F.col("is_code") | ext.isin(DOC_EXTENSIONS))
    c = c.where(F.col("token_count") <= F.when(F.col("is_code"), most_code).otherwise(most_doc))
    return c.withColumn("is_implementation", F.col("is_code") & ~F.lower("file_path").rlike(r"test|spec"))


def listing(files: DataFrame) -> DataFrame:
    """SRC-07, SRT-04: (position, file_path): the tree in order of its paths, whatever the case of letters, dealt out by range and sorted where it lies."""
    return graph.ranked(files.select("file_path"), [F.lower("file_path"), F.col("file_path")], "position").select("position", "file_path")


def readme(files: DataFrame) -> DataFrame:
    """SRC-07: (file_path, content) of the README of the shortest path, then the first."""
    return content(files.where(F.lower(paths.base_name("file_path")).startswith("readme")).orderBy(F.length("file_path"), "file_path").limit(1)).select("file_path", "content")


def known_documents(files: DataFrame) -> DataFrame:
    """SRC-08, SRT-03: well-known markdown of the root, docs and .github, by priority, then name."""
    name = F.lower(paths.base_name("file_path"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KNOWN_DOCS)), name), F.lit(0)), F.lit(99))
    place = F.regexp_extract("file_path", r"^(?:(docs|\.github)/)?[^/]+\.md$", 0) != ""
    return content(files.where(place)).withColumn("priority", rank).orderBy("priority", "file_path")


def expand_env(raw: str, env: dict[str, str] | None = None) -> str:
    """SRC-11, STR-13: ``${NAME}`` from the environment; unknown names stay."""
    values = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], m[0]), raw)


def json_config(path: str, env: dict[str, str] | None = None) -> dict:
    """SRC-11: a small configuration file, on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.loads(expand_env(f.read(), env))


def analysis_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-12, JSN-02: one row a file artifact, by a fixed schema; a file that is no JSON has nulls."""
    return spark.read.schema(schemas.AST_FILE).option("mode", "PERMISSIVE").option("multiLine", True).json(folder)


def symbol_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: an array of symbols."""
    return spark.read.schema(schemas.AST_SYMBOL).option("multiLine", True).json(path)


def line_range(files: DataFrame, path: str, first: int, last: int, most: int = 500) -> DataFrame:
    """SRC-17: (line, text) of a part of one file."""
    lines = files.where(F.col("file_path") == path).select(F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.select((F.col("i") + 1).alias("line"), "text").where(F.col("line").between(first, min(last, first + most - 1)))


def joined_files(wanted: DataFrame, key: str, file_list: str, files: DataFrame, longest: int = 12_288) -> DataFrame:
    """SRC-18: one text of the listed files, each cut to a length, in the order of the list; files that do not exist are left out."""
    each = wanted.select(key, F.posexplode(file_list).alias("_i", "file_path"))
    part = F.struct("_i", F.concat(F.lit("// "), F.col("file_path"), F.lit("\n"), F.left("content", F.lit(longest))).alias("_t"))
    return each.join(files.select("file_path", "content"), "file_path").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "\n\n").alias("text"))


def recovered(artifacts: DataFrame, pages: DataFrame, item: str = "struct<id:string,content:string>") -> DataFrame:
    """SRC-19, JN-07: pages with the content of completed batches laid over them; of several, the one of highest sequence counts."""
    rows = artifacts.where("status = 'completed'").select("sequence", F.explode(F.from_json("payload_json", f"struct<pages:array<{item}>>")["pages"]).alias("p"))
    new = rows.groupBy(F.col("p.id").alias("id")).agg(F.max_by("p.content", "sequence").alias("_new"))
    return pages.join(new, "id", "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def git_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """SRC-10, DAT-02: (time, author, message) of lines ``seconds||author||message``; what is malformed is null."""
    p = F.split(F.col(line), r"\|\|", 3)
    return lines.select(F.timestamp_seconds(F.get(p, 0).try_cast("bigint")).alias("commit_time"), F.nullif(F.trim(F.get(p, 1)), F.lit("")).alias("author"), F.nullif(F.trim(F.get(p, 2)), F.lit("")).alias("message"))


def ndjson(lines: DataFrame, schema: T.StructType | str, line: str = "value") -> DataFrame:
    """SRC-15: one object a line; malformed lines go. For batches and streams."""
    return lines.select(F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"}).alias("_j"), F.try_parse_json(F.col(line)).alias("_ok")).where("_ok is not null").select("_j.*")


def sse(lines: DataFrame, delta: str = "$.text", line: str = "value") -> DataFrame:
    """SRC-16, STM-09: (payload, delta) of ``data:`` lines but the closing mark. For batches and streams."""
    payload = F.regexp_extract(F.col(line), r"^data:\s*(.*)$", 1)
    return lines.select(payload.alias("payload")).where((F.col("payload") != "") & (F.col("payload") != "[DONE]")).withColumn("delta", F.get_json_object("payload", delta))


def page_order(files: DataFrame, order: list[Column]) -> DataFrame:
    return files.orderBy(*order)


def markdown_titles(files: DataFrame) -> DataFrame:
    """(file_path, title, outline) of markdown files."""
    title = F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^# +(.+)$", 1), F.lit("")), paths.base_name("file_path"))
    return files.select("file_path", title.alias("title"), text.outline("content", title).alias("outline"))
