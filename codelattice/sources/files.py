"""Scanning a source tree, and storing nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.ids import file_extension
from codelattice.operators.keep import keep_first, upsert

# File types that are read, and path patterns that are ignored.
EXTENSIONS = ("jsp", "jspx", "xml", "ts", "tsx", "js", "jsx", "py", "c", "h", "cpp", "hpp", "cc", "hh", "java", "cs", "go", "sql", "properties")
IGNORED = ("node_modules/**", ".git/**", "dist/**", "build/**", "target/**", "bin/**", "obj/**", "coverage/**", "public/**", "**/*.test.*", "**/*.spec.*", "**/*.min.js", "**/*.d.ts")


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression on paths with slashes: ``**`` spans folders, ``*`` does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c
            i += 1
    return f"(^|/){out}$"


def kept_path(path: Column, extensions: Sequence[str] = EXTENSIONS, ignored: Sequence[str] = IGNORED) -> Column:
    return file_extension(path).isin(*extensions) & ~path.rlike("|".join(map(glob_to_regex, ignored)))


def scan(spark: SparkSession, root: str, repo: str, *, extensions: Sequence[str] = EXTENSIONS, ignored: Sequence[str] = IGNORED, with_text: bool = False) -> DataFrame:
    """The source files under ``root``: repo_id, path (below the root), name, ext, content_hash,
    mtime, size and, if asked for, text. Files are listed and read by Spark's binaryFile source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    rel = F.regexp_replace(F.substring(path, len(base) + 2, 1 << 20), "^/+", "")
    out = raw.withColumn("path", rel).where(kept_path(F.col("path"), extensions, ignored))
    cols = [F.lit(repo).alias("repo_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), file_extension(F.col("path")).alias("ext"),
            F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return out.select(*cols, *([F.decode("content", "UTF-8").alias("text")] if with_text else []))


def last_per_id(rows: DataFrame, order: str, key: str = "entity_id") -> DataFrame:
    """Of rows with the same id the last one counts."""
    return keep_first(rows, [key], [F.col(order).desc()])


def store(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus a bare one for each end of an edge that has none."""
    ends = edges.select("repo_id", F.col("src").alias("entity_id")).union(edges.select("repo_id", "dst")).distinct()
    missing = ends.join(nodes.select("entity_id"), "entity_id", "left_anti")
    return nodes.unionByName(missing, allowMissingColumns=True)


def upsert_nodes(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    return upsert(old, last_per_id(new, order).drop(order), "entity_id")


def repository_structure(nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The repository's node, and an edge to it from each of its files."""
    files = nodes.where(F.col("kind") == "File").select("entity_id")
    top = nodes.sparkSession.createDataFrame([(f"repository:{repo}", "Repository", repo)], "entity_id string, kind string, name string")
    return top, files.select(F.lit("BELONGS_TO").alias("type"), F.col("entity_id").alias("src"), F.lit(f"repository:{repo}").alias("dst"))


def module_structure(modules: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of modules (module, root), their dependencies (module, target or group, artifact,
    version) and files (path, module)."""
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst"))
    own = dependencies.where("target is not null").join(modules.select(F.col("module").alias("target")), "target", "left_semi")
    outside = dependencies.where("target is null").withColumn("gav", F.concat_ws(":", "group", "artifact", "version")).dropDuplicates(["module", "gav"])
    return (
        edge(own, "DEPENDS_ON_MODULE", "module", "target").unionByName(edge(outside, "HAS_DEPENDENCY", "module", "gav"))
        .unionByName(edge(files, "CONTAINS_FILE", "module", "path")).unionByName(edge(files, "DEFINED_IN_MODULE", "path", "module")).distinct()
    )


def without(df: DataFrame, column: str, value: str) -> DataFrame:
    """What is left of a store when a repository (or any other value of a column) is deleted; nulls stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def delete_repository(spark: SparkSession, path: str, repo: str) -> int:
    """Delete a repository from a store that is partitioned by repo_id: its folder goes, nothing is rewritten. Returns how many rows it had."""
    rows = spark.read.parquet(path)
    n = rows.where(F.col("repo_id") == repo).count()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/repo_id={repo}")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return n


def find(spark: SparkSession, root: str, glob: str, most: int = 100) -> DataFrame:
    """(path, size, mtime) of at most ``most`` files below ``root`` that a glob fits, by path; their content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return raw.where(F.col("path").rlike(glob_to_regex(glob))).orderBy("path").limit(most)


def read_batch(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, text) of the named files, read in tasks."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.decode("content", "UTF-8").alias("text"))
