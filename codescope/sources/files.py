"""Loading, scoping and cutting up source files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions.text import any_of, contains_ci, file_stem, glob_match

# Endings of generated files, and build output folders.
GENERATED_SUFFIXES = [".g.cs", ".generated.cs", ".Designer.cs"]
BUILD_FOLDERS = ["obj", "bin"]
# Endings of test file names, and test folders.
TEST_SUFFIXES = ["Test", "Tests", "Spec", "Specs"]
TEST_FOLDERS = ["Tests", "test"]

_GENERATED = "(?i)(?:" + "|".join(re.escape(x) for x in GENERATED_SUFFIXES) + ")$"
_BUILD = r"(?i)(?:^|[/\\])(?:" + "|".join(BUILD_FOLDERS) + r")[/\\]"
_TEST_NAME = "(?i)(?:" + "|".join(TEST_SUFFIXES) + ")$"
_TEST_FOLDER = r"(?i)[/\\](?:" + "|".join(TEST_FOLDERS) + r")[/\\]"


def is_generated(path):
    return path.rlike(_GENERATED)


def is_test(path):
    return file_stem(path).rlike(_TEST_NAME) | path.rlike(_TEST_FOLDER)


def read_files(
    spark: SparkSession,
    root: str,
    glob: str = "*",
    project: str = r"^([^/]+)/",
    path: str = r"^(.*)$",
) -> DataFrame:
    """All text files under ``root`` as ``project, path, content``.

    ``project`` and ``path`` are regexes whose first group is taken from the file's
    path relative to ``root``. Generated files and build output are dropped before
    any content is used.
    """
    # Paths are URL-encoded, except for a plus sign, which decoding would turn into a space.
    location = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    folder = re.sub(r"^[A-Za-z0-9+.-]+:", "", root).strip("/") + "/"
    start = F.instr(location, F.lit(folder)) + len(folder)
    relative = F.substr(location, start)
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .select(relative.alias("_rel"), F.col("value").alias("content"))
    )
    logical = F.regexp_extract("_rel", path, 1)
    return (
        files.select(
            F.regexp_extract("_rel", project, 1).alias("project"), logical.alias("path"), "content"
        )
        .where(~is_generated(F.col("path")))
        .where(~F.col("path").rlike(_BUILD))
    )


BUNDLED = "path STRING, content STRING"


def write_bundles(files: DataFrame, root: str) -> None:
    """Write ``files`` (project, path, content) as bundles: a JSON object a line for each file, in
    a folder per project. A tree of very many small files is better kept like this."""
    value = F.to_json(F.struct("path", "content")).alias("value")
    files.select("project", value).write.partitionBy("project").text(root)


def read_bundles(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """The files in the bundles under ``root``, as ``read_files`` gives single ones."""
    lines = spark.read.schema("value STRING, project STRING").text(root, pathGlobFilter=glob)
    files = lines.select("project", F.from_json("value", BUNDLED).alias("_file")).select("project", "_file.*")
    return files.where(~is_generated(F.col("path"))).where(~F.col("path").rlike(_BUILD))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number; other columns are kept."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(
        *keep, F.posexplode(F.split("content", "\n", -1)).alias("_pos", "text")
    ).select(*keep, (F.col("_pos") + 1).alias("line_no"), "text")


def scope(
    df: DataFrame,
    project: str | None = None,
    path: str | None = None,
    glob: str | None = None,
    mode: str = "equals",
) -> DataFrame:
    """Keep the rows of a project, path (whole or suffix) or glob, ignoring case."""
    if mode not in ("equals", "contains"):
        raise ValueError(f"mode must be equals or contains: {mode}")
    if project is not None:
        same = F.lower("project") == project.lower()
        df = df.where(same if mode == "equals" else contains_ci(F.col("project"), project))
    if path is not None:
        df = df.where(F.endswith(F.lower("path"), F.lit(path.lower())))
    if glob is not None:
        df = df.where(glob_match(F.col("path"), glob))
    return df


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``is_test`` and ``is_generated``."""
    path = F.col("path")
    return files.withColumns({"is_test": is_test(path), "is_generated": is_generated(path)})


def without_test_projects(df: DataFrame) -> DataFrame:
    """Drop the projects that hold tests or benchmarks."""
    return df.where(~F.col("project").rlike(r"(?i)\.(?:tests|benchmarks)$"))


def extract_facts(
    lines: DataFrame, patterns: Sequence[tuple[str, str, int]], text: str = "text"
) -> DataFrame:
    """One row per capture of each ``(fact_kind, regex, group)``, in one pass over the text."""

    def captured(kind: str, regex: str, group: int):
        values = F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(group))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("fact_kind"), v.alias("value")))

    captures = [captured(*pattern) for pattern in patterns]
    keep = [c for c in lines.columns if c != text]
    hit = any_of([F.col(text).rlike(regex) for _, regex, _ in patterns])
    return (
        lines.where(hit)
        .select(*keep, F.explode(F.concat(*captures)).alias("_fact"))
        .select(*keep, "_fact.fact_kind", "_fact.value")
    )


# Patterns for the facts the detectors use: imports, namespaces, package references,
# attributes and plain string literals. They read single lines and know no scopes.
FACT_PATTERNS = [
    ("import", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", 1),
    ("namespace", r"^\s*namespace\s+([\w.]+)", 1),
    ("package", r'<PackageReference\s+Include="([^"]+)"', 1),
    ("attribute", r"^\s*\[(\w+)", 1),
    ("declaration", r"\b(?:class|interface|struct|enum|record)\s+(\w+)", 1),
    ("literal", r'"([^"\\]*)"', 1),
]

