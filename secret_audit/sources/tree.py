"""Repository trees on a shared file system or in an object store.

Spark's file sources hide names that begin with a dot or underscore, and ``.env`` is the first file a secret scan wants. So
trees are listed by Spark tasks, level by level: the folders found on one level are dealt out anew for the next, and the
driver lists nothing. Listing gives paths and sizes only; bodies are read after selection, by tasks over evenly spread paths,
however many files a folder has. A root is a path, a ``file://`` address or one that pyarrow's file systems know (``hdfs://``,
``s3://``, ``gs://``), as every executor reaches it.
"""

from __future__ import annotations

import os
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.functions.text import decode_ignore, decode_strict
from secret_audit.operators.merge import union_all
from secret_audit.sources.store import materialize

# Worker code travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_READ_BATCH_BYTES = 32 << 20
_FOLDERS_PER_TASK, _FILES_PER_TASK, _BYTES_PER_TASK = 64, 256, 64 << 20
_ENTRY = "path string, size long, folder boolean, error string"
_BODY = "repo string, file_path string, size long, raw binary, error string"


class _LocalStore:
    """Files below a mounted folder. Links to files are followed, links to folders are not."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str):
        """(path, size, is a folder, error) of what a folder holds."""
        try:
            found = list(os.scandir(os.path.join(self.root, folder)))
        except OSError as e:
            yield folder or ".", None, False, str(e.strerror or e)
            return
        for entry in found:
            path = os.path.join(folder, entry.name)
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield path, None, True, None
                elif entry.is_file():
                    yield path, entry.stat().st_size, False, None
                elif entry.is_symlink() and not os.path.exists(entry.path):
                    yield path, None, False, "broken link"
            except OSError as e:
                yield path, None, False, str(e.strerror or e)

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()

    def write(self, path: str, raw: bytes) -> None:
        target = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(raw)


class _RemoteStore:
    """Files below an address that pyarrow's file systems reach."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.selector, self.kinds = fs.FileSelector, fs.FileType

    def entries(self, folder: str):
        try:
            found = self.fs.get_file_info(self.selector(f"{self.base}/{folder}".rstrip("/")))
        except OSError as e:
            yield folder or ".", None, False, str(e)
            return
        for entry in found:
            path = f"{folder}/{entry.base_name}".lstrip("/")
            if entry.type in (self.kinds.Directory, self.kinds.File):
                is_folder = entry.type == self.kinds.Directory
                yield path, None if is_folder else entry.size, is_folder, None

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{path}", compression=None) as f:
            return f.read()

    def write(self, path: str, raw: bytes) -> None:
        self.fs.create_dir(os.path.dirname(f"{self.base}/{path}"), recursive=True)
        with self.fs.open_output_stream(f"{self.base}/{path}", compression=None) as f:
            f.write(raw)


def _store(root: str):
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return _RemoteStore(root) if "://" in root else _LocalStore(os.path.abspath(root))


def _listed(root: str):
    def run(batches):
        store = _store(root)
        for batch in batches:
            rows = [entry for folder in batch["path"] for entry in store.entries(folder)]
            frame = pd.DataFrame(rows, columns=["path", "size", "folder", "error"])
            yield frame.astype({"size": "Int64"})

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """file_path, size and error of every file; a folder or file that can't be looked at has the error and no size.

    One job per level of the tree; its folders are spread over tasks. The listing is stored in the shared folder.
    """
    levels, folders, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        # A number of its own, because the few bytes of the paths say nothing about the work.
        spread = folders.repartition(-(-n // _FOLDERS_PER_TASK), "path")
        level = materialize(spread.mapInPandas(_listed(root), _ENTRY), "tree-level")
        levels.append(level.where(~F.col("folder")))
        folders = level.where("folder").select("path")
        n = folders.count()
    return union_all(*levels).select(F.col("path").alias("file_path"), "size", "error")


def _read_bodies(root: str):
    def frame(rows):
        return pd.DataFrame(rows, columns=["repo", "file_path", "size", "raw", "error"])

    def read(batches):
        store, rows, held = _store(root), [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw, error = None, row.error
                if error is None:
                    try:
                        raw = store.read(row.path)
                    except OSError as e:
                        error = str(e.strerror or e)
                size = len(raw) if raw is not None and pd.isna(row.size) else row.size
                rows.append((row.repo, row.file_path, None if pd.isna(size) else int(size), raw, error))
                held += len(raw or b"")
                if held > _READ_BATCH_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    return read


def tree_bodies(spark: SparkSession, root: str, repo: str | None = None, select=None) -> DataFrame:
    """repo, file_path, size, raw and error of every file of a tree.

    Without ``repo`` the tree holds many repositories, one per top folder; files at the top belong to one named like the
    root. ``select`` filters the listing (repo, file_path, size) before any body is read.
    """
    listing = list_tree(spark, root).withColumnRenamed("file_path", "path")
    if repo is None:
        below = F.col("path").contains("/")
        listing = listing.withColumns({
            "repo": F.when(below, F.substring_index("path", "/", 1)).otherwise(root.rstrip("/").rpartition("/")[2]),
            "file_path": F.regexp_replace("path", "^[^/]*/", ""),
        })
    else:
        listing = listing.withColumns({"repo": F.lit(repo), "file_path": F.col("path")})
    chosen = select(listing) if select else listing
    work = chosen.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-work[0] // _FILES_PER_TASK), -(-work[1] // _BYTES_PER_TASK))
    even = chosen.select("path", "repo", "file_path", "size", "error").repartition(int(tasks), "path")
    return even.mapInPandas(_read_bodies(root), _BODY)


def read_tree(
    spark: SparkSession, root: str, repo: str | None = None, commit_sha: str | None = None, select=None, strict: bool = False
) -> DataFrame:
    """Files of a tree in the canonical columns; those that can't be read are in ``tree_rejects``.

    Undecodable bytes are dropped, or with ``strict`` the file.
    """
    decode = decode_strict if strict else decode_ignore
    return tree_bodies(spark, root, repo, select).select(
        "repo", F.lit(commit_sha).cast("string").alias("commit_sha"), "file_path",
        decode(F.col("raw")).alias("content"), "size",
    ).where(F.col("content").isNotNull())


def tree_rejects(spark: SparkSession, root: str, repo: str | None = None, select=None, strict: bool = False) -> DataFrame:
    """repo, file_path, size and reason of what ``read_tree`` leaves out: unreadable files and folders, and bad encodings."""
    bodies = tree_bodies(spark, root, repo, select)
    reason = F.when(F.col("raw").isNull(), F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit("no body"))))
    if strict:
        reason = reason.when(decode_strict(F.col("raw")).isNull(), "invalid_utf8")
    return bodies.select("repo", "file_path", "size", reason.alias("reason")).where(F.col("reason").isNotNull())


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, raw) as files below a root that every executor reaches."""
    def write(batches):
        store = _store(root)
        for batch in batches:
            for path, raw in zip(batch["path"], batch["raw"], strict=True):
                clean = os.path.normpath(path)
                if clean.startswith(("..", "/")):
                    raise ValueError(f"{path} leaves the folder")
                store.write(clean, raw)
            yield pd.DataFrame({"written": [len(batch)]})

    files.select("path", "raw").mapInPandas(write, "written long").agg(F.sum("written")).collect()  # one number
