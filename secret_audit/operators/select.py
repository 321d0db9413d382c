"""File selection: which rows of a files table are scanned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secret_audit.functions.regex import fnmatch_to_java, glob_to_java
from secret_audit.functions.text import decode_strict
from secret_audit.operators.numbering import top_cutoff

# Selection defaults.
DEFAULT_INCLUDE = ("**/*.py", "**/*.js", "**/*.env", "**/*.yml")
DEFAULT_EXCLUDE = ("**/node_modules/**", "**/dist/**", ".git/**")
ENGINE_INCLUDE = ("**/*",)
ENGINE_EXCLUDE = (
    "**/node_modules/**", "**/dist/**", "**/.git/**", "**/__pycache__/**", "**/*.pyc", "**/*.pyo",
)
# Limits of the usual scan request. They are off unless a caller asks for them, as in ``**REQUEST_LIMITS``.
REQUEST_LIMITS = {"max_files": 2000, "max_bytes_per_file": 200_000}
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "img", "iso", "zip", "tar", "gz", "rar", "7z", "pdf", "doc", "docx", "xls",
    "xlsx", "ppt", "pptx", "jpg", "jpeg", "png", "gif", "bmp", "tiff", "svg", "mp3", "mp4", "avi", "mov", "wav", "flac",
)
PRUNE_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt",
)
PRUNE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "pdf", "zip", "tar", "gz")


def _any(flags) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def included(path: Column, patterns=DEFAULT_INCLUDE) -> Column:
    return _any(path.rlike(glob_to_java(p)) for p in patterns)


def excluded(path: Column, patterns=DEFAULT_EXCLUDE, strict: bool = True) -> Column:
    """Shell-match exclusion. With ``strict=False`` a leading ``**/`` also covers the top level."""
    hit = _any(path.rlike(fnmatch_to_java(p)) for p in patterns)
    if not strict:
        hit = hit | _any(path.rlike(fnmatch_to_java(p[3:])) for p in patterns if p.startswith("**/"))
    return hit


def is_binary_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + r")\z")


def is_pruned_path(path: Column) -> Column:
    dirs = "|".join(d.replace(".", r"\.") for d in PRUNE_DIRS)
    return path.rlike(f"(^|/)({dirs})/") | F.lower(path).rlike(r"\.(" + "|".join(PRUNE_EXTENSIONS) + r")\z")


def is_removed(status: Column) -> Column:
    return F.coalesce(status == "removed", F.lit(False))


def has_content(content: Column) -> Column:
    return F.octet_length(content) > 0


def file_size(files: DataFrame) -> Column:
    """The stored size, or that of the text where none is stored."""
    return F.coalesce("size", F.octet_length("content").cast("long")) if "content" in files.columns else F.col("size")


def _beyond(files: DataFrame, max_files: int, scope: str) -> DataFrame:
    """The files with ``_cut``: the last path that a repository with more than ``max_files`` files keeps, else null.

    Only over-full repositories are in the joined table, so the text rows stay where they are; a null repository is one too.
    """
    cut = top_cutoff(files, scope, F.col("file_path"), max_files).withColumnRenamed(scope, "_scope")
    return files.join(cut, files[scope].eqNullSafe(cut["_scope"]), "left").drop("_scope")


def limit_files(files: DataFrame, max_files: int, scope: str = "repo") -> DataFrame:
    """The first ``max_files`` paths per repo in path order."""
    kept = F.col("_cut").isNull() | (F.col("file_path") <= F.col("_cut"))
    return _beyond(files, max_files, scope).where(kept).select(*files.columns)


def _rejections(files: DataFrame, include, exclude, max_bytes_per_file, strict) -> list[tuple[str, Column]]:
    """Why a file is left out, in the order in which reasons count; a condition is never null."""
    path = F.coalesce("file_path", F.lit(""))
    found = [("not_included", ~included(path, include)), ("excluded", excluded(path, exclude, strict))]
    if max_bytes_per_file is not None:
        found.append(("too_large", F.coalesce(file_size(files) > max_bytes_per_file, F.lit(False))))
    return found


def select_files(
    files: DataFrame,
    include=DEFAULT_INCLUDE,
    exclude=DEFAULT_EXCLUDE,
    max_files: int | None = None,
    max_bytes_per_file: int | None = None,
    strict: bool = True,
    scope: str = "repo",
) -> DataFrame:
    """Include, exclude, size and count limits of a scan request; what it leaves out is in ``selection_rejects``."""
    kept = files
    if max_bytes_per_file is not None:  # implied by the condition below, in a form that reaches the scan
        kept = kept.where(F.col("size").isNull() | (F.col("size") <= max_bytes_per_file))
    kept = kept.where(~_any(c for _, c in _rejections(files, include, exclude, max_bytes_per_file, strict)))
    return limit_files(kept, max_files, scope) if max_files is not None else kept


def selection_flags(
    files: DataFrame,
    include=DEFAULT_INCLUDE,
    exclude=DEFAULT_EXCLUDE,
    max_files: int | None = None,
    max_bytes_per_file: int | None = None,
    strict: bool = True,
    scope: str = "repo",
) -> DataFrame:
    """Per file why it is scanned or not, by the same conditions as ``select_files``."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(_rejections(files, include, exclude, max_bytes_per_file, strict)):
        reason = F.when(condition, name).otherwise(reason)
    flagged = files.withColumn("selection", F.coalesce(reason, F.lit("selected")))
    if max_files is None:
        return flagged
    chosen = F.col("selection") == "selected"
    cut = top_cutoff(flagged.where(chosen), scope, F.col("file_path"), max_files).withColumnRenamed(scope, "_scope")
    joined = flagged.join(cut, flagged[scope].eqNullSafe(cut["_scope"]), "left")
    over = chosen & F.coalesce(F.col("file_path") > F.col("_cut"), F.lit(False))
    return joined.withColumn("selection", F.when(over, "over_limit").otherwise(F.col("selection"))).drop("_scope", "_cut")


def selection_rejects(files: DataFrame, **request) -> DataFrame:
    """Every file that ``select_files`` leaves out, with its reason and without its text."""
    flagged = selection_flags(files, **request).where(F.col("selection") != "selected")
    return flagged.drop("content").withColumnRenamed("selection", "reason")


def split_rejects(files: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Undecodable or missing bodies go to a rejects table with a reason, the rest is text in ``content``."""
    checked = files.withColumn("content", decode_strict(F.col(raw)))
    reason = F.when(F.col(raw).isNull(), "missing_content").otherwise("invalid_utf8")
    good = checked.where(F.col("content").isNotNull()).drop(raw)
    bad = checked.where(F.col("content").isNull()).withColumn("reason", reason).drop(raw, "content")
    return good, bad
