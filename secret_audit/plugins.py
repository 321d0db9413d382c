"""Extension points as DataFrame functions.

Detectors take files and give matches, connectors take a session and a path and give files, handlers take findings and give plan rows, classifiers
add confidence, label and reasoning. A plugin is registered by name and can be switched off.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secret_audit.functions.mask import fingerprint, mask_generic
from secret_audit.operators import detect
from secret_audit.operators.merge import union_all
from secret_audit.operators.remediation import remediation_plan
from secret_audit.operators.scoring import classify_by_rule
from secret_audit.operators.verdicts import parse_classification
from secret_audit.rules import COMMIT_PACK, CONTENT_PACK, PLUGIN_PACK
from secret_audit.sources.commits import read_commits
from secret_audit.sources.files import read_files
from secret_audit.sources.store import materialize
from secret_audit.sources.tree import read_tree

# The row detector travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Detector = Callable[[DataFrame], DataFrame]
Connector = Callable[..., DataFrame]
Handler = Callable[[DataFrame], DataFrame]
Classifier = Callable[[DataFrame], DataFrame]

_KINDS = ("detector", "connector", "handler", "classifier")


@dataclass
class Registry:
    _plugins: dict[str, dict[str, Callable]] = field(default_factory=lambda: {k: {} for k in _KINDS})
    _off: set[tuple[str, str]] = field(default_factory=set)

    def register(self, kind: str, name: str):
        """Decorator that stores a function under a name; a later function replaces an earlier one."""
        table = self._plugins[kind]

        def add(fn):
            table[name] = fn
            return fn

        return add

    def enable(self, kind: str, name: str, enabled: bool = True) -> None:
        if name not in self._plugins[kind]:
            raise KeyError(f"no {kind} named {name!r}")
        (self._off.discard if enabled else self._off.add)((kind, name))

    def enabled(self, kind: str) -> dict[str, Callable]:
        return {n: fn for n, fn in self._plugins[kind].items() if (kind, n) not in self._off}

    def get(self, kind: str, name: str) -> Callable:
        found = self.enabled(kind).get(name)
        if found is None:
            raise ValueError(f"unknown or disabled {kind}: {name!r}")
        return found

    def detect(self, files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """Matches of the named detectors, or of all enabled ones."""
        chosen = [self.get("detector", n) for n in names] if names else list(self.enabled("detector").values())
        return union_all(*[d(files) for d in chosen])

    def detect_each(self, files: DataFrame, names: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Matches of the detectors that work, and a table (detector, reason) of those that fail, which are skipped.

        Each detector's result is written by itself, so that an error in its tasks ends that detector only. ``files`` is read
        once per detector.
        """
        spark, found, failed = files.sparkSession, [], []
        for name in names or self.enabled("detector"):
            try:
                found.append(materialize(self.get("detector", name)(files), f"detector-{name}"))
            except Exception as e:  # a detector may fail in any way
                failed.append((name, str(e).strip().split("\n")[0][:500]))
        rejects = spark.createDataFrame(failed, "detector string, reason string")
        empty = files.limit(0).withColumn("type", F.lit(None).cast("string")).drop("content")
        return union_all(*found) if found else empty, rejects


registry = Registry()


@registry.register("detector", "regex")
def regex_detector(files: DataFrame) -> DataFrame:
    return detect.mask_hits(detect.scan_lines(files, PLUGIN_PACK)).drop("secret", "line")


@registry.register("detector", "content")
def content_detector(files: DataFrame) -> DataFrame:
    return detect.findings_from_content(files, CONTENT_PACK)


@registry.register("detector", "commit")
def commit_detector(files: DataFrame) -> DataFrame:
    return detect.scan_lines_with_entropy(files, COMMIT_PACK)


registry.register("connector", "files")(read_files)
registry.register("connector", "tree")(read_tree)
registry.register("connector", "commits")(read_commits)


@registry.register("handler", "aws_remediation")
def aws_handler(findings: DataFrame) -> DataFrame:
    return remediation_plan(findings)


registry.register("classifier", "rule")(classify_by_rule)
# The trained classifier has no model and answers like the rules.
registry.register("classifier", "ml")(classify_by_rule)


@registry.register("classifier", "llm")
def verdict_classifier(hits: DataFrame) -> DataFrame:
    """Uses the reply in ``llm_reply`` where there is one, else the rules."""
    base = classify_by_rule(hits)
    if "llm_reply" not in hits.columns:
        return base
    answer = F.when(F.col("llm_reply").isNotNull(), parse_classification(F.col("llm_reply")))
    return base.withColumn("_a", answer).withColumns({
        "class_confidence": F.coalesce(F.col("_a.confidence"), F.col("class_confidence")),
        "label": F.coalesce(F.col("_a.label"), F.col("label")),
        "reasoning": F.coalesce(F.col("_a.reasoning"), F.col("reasoning")),
    }).drop("_a")


def get_classifier(name: str = "rule") -> Classifier:
    return registry.get("classifier", name)


def row_detector(match: Callable[[str, str], Iterable[tuple[str, float, int, str]]]) -> Detector:
    """Detector from a Python function (path, content) -> (type, confidence, line, secret) tuples.

    Opt-in for detectors that no pattern expresses: text crosses to Python in Arrow batches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.repo, r.file_path, kind, confidence, line, line, secret)
                for r in pdf.itertuples(index=False) if r.content is not None
                for kind, confidence, line, secret in match(r.file_path, r.content)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=[
                    "repo", "file_path", "type", "confidence", "line_start", "line_end", "secret"
                ])

    def detector(files: DataFrame) -> DataFrame:
        schema = "repo string, file_path string, type string, confidence double, line_start int, line_end int, secret string"
        found = files.select("repo", "file_path", "content").mapInPandas(run, schema)
        return found.withColumns({
            "fingerprint": fingerprint(F.col("secret")), "masked_preview": mask_generic(F.col("secret")),
            "engine": F.lit("custom"),
        }).drop("secret")

    return detector


def row_table_function(match: Callable[[str, str], Iterable[tuple[str, float, int, str]]]):
    """The same kind of function as a table function for lateral joins: (path, content) to type, confidence, line_start, secret.

    Rows go to Python a hundred at a time; Arrow would hold a batch of ten thousand texts and build a frame for each.
    """
    class Matches:
        def eval(self, path: str, content: str):
            if content is not None:
                yield from match(path, content)

    return F.udtf(Matches, returnType="type string, confidence double, line_start int, secret string")


def checksum_numbers(path: str, content: str) -> Iterator[tuple[str, float, int, str]]:
    """Runs of six or more digits whose Luhn checksum is right, which no pattern can tell: payment cards, device and account numbers."""
    import re

    for n, line in enumerate(content.split("\n"), 1):
        for digits in re.findall("[0-9]{6,}", line):
            odd, even = digits[-1::-2], digits[-2::-2]
            if (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0:
                yield "checksum_number", 0.5, n, digits
