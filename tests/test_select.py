import fnmatch
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from secret_audit.functions import text as T
from secret_audit.operators import select as S
from secret_audit.sources.tree import list_tree, read_tree, tree_rejects

PATHS = [
    "root.py", "a/b.py", "a/b/c.js", ".env", "svc/.env", "svc/prod.env", "a.yml", "node_modules/x.js", "a/node_modules/x.js", "dist/x.py",
    "a/dist/b/x.py", ".git/config.py", "a/.git/x.py", "a.pyc", "a/b.pyc", "[x].py", "a b/c+d.py", "x.PY", "deep/er/and/deeper/f.py", "a/__pycache__/m.py",
]
GLOBS = ["**/*.py", "*.py", "**/*", "a/*.py", "a/**/*.js", "**/.env", "?.yml", "a*/**", "**/[ab].py", "**/[[]x].py"]


def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "file_path string")


def chosen(df, condition):
    return {r[0] for r in df.where(condition).collect()}


def test_include_equals_pathlib(spark, tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    df = paths(spark)
    for g in GLOBS:
        want = {str(f.relative_to(tmp_path)) for f in Path(tmp_path).glob(g) if f.is_file()}
        if g.endswith("**"):
            # This Python version lists files below a final ``**``.
            want = {p for p in PATHS if p.startswith("a") and "/" in p}
        assert chosen(df, S.included(F.col("file_path"), [g])) == want, g


def test_exclude_equals_fnmatch(spark):
    df = paths(spark)
    for g in [*S.DEFAULT_EXCLUDE, *S.ENGINE_EXCLUDE, *GLOBS, "*", "[!a]*"]:
        want = {p for p in PATHS if fnmatch.fnmatchcase(p, g)}
        assert chosen(df, S.excluded(F.col("file_path"), [g])) == want, g


def test_exclude_at_the_top_level(spark):
    df = paths(spark)
    path = F.col("file_path")
    assert "node_modules/x.js" not in chosen(df, S.excluded(path, S.ENGINE_EXCLUDE))
    assert {"node_modules/x.js", "a.pyc", ".git/config.py"} <= chosen(df, S.excluded(path, S.ENGINE_EXCLUDE, strict=False))


def test_binary_and_pruned(spark):
    rows = ["a.EXE", "a.exe.txt", "b.tar", "c.flac", "dll", "d.docx", "venv/x.py", "x/env/y", "environment/y", "a/.next/b", "i.ICO", "env"]
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    assert chosen(df, S.is_binary_path(F.col("p"))) == {"a.EXE", "b.tar", "c.flac", "d.docx"}
    assert chosen(df, S.is_pruned_path(F.col("p"))) == {"b.tar", "venv/x.py", "x/env/y", "a/.next/b", "i.ICO"}


def test_limit_files_with_one_large_repo(spark):
    rows = [("big", f"f{i:05d}") for i in range(3000)] + [("small", f"f{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "repo string, file_path string").withColumn("content", F.lit("x"))
    kept = S.limit_files(df, 50)
    got = sorted((r.repo, r.file_path) for r in kept.collect())
    assert got == sorted(rows[:50] + rows[-3:])


def test_nothing_is_lost_in_selection(spark):
    rows = [("r", f"a{i}.py", "x" * i, i if i % 2 else None) for i in range(8)] + [(None, f"b{i}.py", "x", 1) for i in range(5)]
    rows += [("r", None, "x", 1), ("r", "n.md", None, None), ("r", "none.py", None, None)]
    files = spark.createDataFrame(rows, "repo string, file_path string, content string, size long")
    assert S.select_files(files).count() == 14  # no limit unless asked for
    request = {"max_files": 3, "max_bytes_per_file": 5}
    kept, left = S.select_files(files, **request), S.selection_rejects(files, **request)
    assert sorted((str(r.repo), r.file_path) for r in kept.collect()) == [("None", f"b{i}.py") for i in range(3)] + [("r", f"a{i}.py") for i in range(3)]
    assert sorted((str(r.file_path), r.reason) for r in left.collect()) == sorted(
        [("None", "not_included"), ("n.md", "not_included"), ("none.py", "over_limit"), ("b3.py", "over_limit"), ("b4.py", "over_limit")]
        + [(f"a{i}.py", "over_limit") for i in (3, 4, 5)] + [(f"a{i}.py", "too_large") for i in (6, 7)])
    assert "content" not in left.columns


def test_decodes(spark):
    cases = [(b"caf\xc3\xa9", "café", "café"), (b"a\xffb\xc3", "ab", None), (b"", "", ""), (b"\xed\xa0\x80x", "x", None)]
    df = spark.createDataFrame([(bytearray(b), i, s) for b, i, s in cases], "raw binary, ignored string, strict string")
    for r in df.withColumns({"i": T.decode_ignore(F.col("raw")), "s": T.decode_strict(F.col("raw"))}).collect():
        assert r.i == bytes(r.raw).decode("utf-8", "ignore") == r.ignored
        assert r.s == r.strict


def test_base64_body(spark):
    df = spark.createDataFrame([("aGVs\nbG8=\n",), ("not base64!",), ("/w==",)], "b string")
    assert [r[0] for r in df.select(T.decode_base64(F.col("b"))).collect()] == ["hello", None, None]


def test_small_texts(spark):
    df = spark.createDataFrame([("https://github.com/a/b/",), ("https://github.com/a",), ("git@github.com:a/b",),
                                ("http://x/github.com/a/b//",)], "u string")
    got = [tuple(r) for r in df.select(T.is_repo_url(F.col("u")), T.repo_name(F.col("u"))).collect()]
    assert got == [(True, "a/b"), (False, "a"), (False, None), (False, "a/b")]
    words = spark.createDataFrame([("",), ("  a  b\n",), ("x y",)], "t string")
    assert [r[0] for r in words.select(T.word_count(F.col("t"))).collect()] == [0, 2, 2]
    bands = spark.createDataFrame([(80.0,), (79.99,), (60.0,), (40.0,), (0.0,)], "s double")
    assert [r[0] for r in bands.select(T.risk_band(F.col("s"))).collect()] == ["Critical", "High", "High", "Medium", "Low"]


def test_tree_with_hidden_files_and_bad_bytes(spark, tmp_path):
    for name, body in {
        ".env": b"password = 'hunter22'", "_w.py": b"x", "_x/deep/er/a.py": b"y", "a/.hidden/b.py": b"\xffz", "big.py": b"q" * 500, "bin.png": b"\x00",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    os.symlink(tmp_path / "missing", tmp_path / "broken")
    assert {r.file_path for r in list_tree(spark, str(tmp_path)).collect()} == {
        ".env", "_w.py", "_x/deep/er/a.py", "a/.hidden/b.py", "big.py", "bin.png", "broken"}
    select = lambda df: df.where((F.col("size") <= 200) & ~S.is_binary_path(F.col("file_path")))
    got = {r.file_path: r.content for r in read_tree(spark, str(tmp_path), "r", select=select).collect()}
    assert got == {".env": "password = 'hunter22'", "_w.py": "x", "_x/deep/er/a.py": "y", "a/.hidden/b.py": "z"}
    many = {(r.repo, r.file_path) for r in read_tree(spark, str(tmp_path)).collect()}
    top = {(tmp_path.name, n) for n in (".env", "_w.py", "big.py", "bin.png")}
    assert many == {("_x", "deep/er/a.py"), ("a", ".hidden/b.py")} | top
    left = {(r.file_path, r.reason) for r in tree_rejects(spark, str(tmp_path), "r", strict=True).collect()}
    assert left == {("broken", "unreadable: broken link"), ("a/.hidden/b.py", "invalid_utf8")}
    strict = {r.file_path for r in read_tree(spark, str(tmp_path), "r", select=select, strict=True).collect()}
    assert strict == {".env", "_w.py", "_x/deep/er/a.py"}


def test_tree_is_listed_level_by_level(spark, tmp_path):
    """Deep and full folders, links and a root given as an address."""
    from secret_audit.sources.tree import _RemoteStore, list_tree, read_tree, tree_rejects, write_tree

    rows = [(f"a/{'d/' * (i % 6)}.f{i}", bytes([65 + i % 26]) * i) for i in range(60)] + [("a/full/_" + str(i), b"x") for i in range(500)] + [("top", b"t")]
    root = tmp_path / "tree"
    write_tree(spark.createDataFrame(rows, "path string, raw binary").repartition(3), str(root))
    (root / "loop").symlink_to(root)
    (root / "broken").symlink_to(root / "nowhere")
    (root / "link").symlink_to(root / "top")
    for address in (str(root), f"file://{root}", f"file:{root}"):
        found = {r.file_path: (r["size"], r.error) for r in list_tree(spark, address).collect()}
        assert found == {p: (len(raw), None) for p, raw in rows} | {"broken": (None, "broken link"), "link": (1, None)}
    bodies = read_tree(spark, str(root), repo="r")
    assert {(r.file_path, r.content) for r in bodies.collect()} >= {(p, raw.decode()) for p, raw in rows}
    assert [(r.file_path, r.reason) for r in tree_rejects(spark, str(root), repo="r").collect()] == [("broken", "unreadable: broken link")]
    spread = bodies.select(F.spark_partition_id().alias("p")).where("file_path like 'a/full/%'").distinct().count()
    assert spread > 1
    remote = _RemoteStore(f"file://{root}/a")
    assert sorted(e for e in remote.entries("full"))[0] == ("full/_0", 1, False, None) and remote.read("full/_7") == b"x"
    remote.write("new/.x", b"1")
    assert (root / "a/new/.x").read_bytes() == b"1" and list(remote.entries("none"))[0][3]
    with pytest.raises(Exception, match="leaves the folder"):
        write_tree(spark.createDataFrame([("../x", b"")], "path string, raw binary"), str(root))
