"""Union, first-wins dedupe and the finding lifecycle.

First-wins dedupe is an aggregation, not a window: copies of one finding collapse before the shuffle, so a key that
holds most of the rows costs no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secret_audit.schemas import PATCH_STATUSES, STATUSES

FINDING_KEY = ("repo", "fingerprint", "file_path")
LEGACY_KEY = ("fingerprint", "file_path")
#: Most keys of a run whose digests are broadcast to the history: 8 bytes each.
MOST_KEYS = 2_000_000


def finding_key(legacy_key: bool = False) -> tuple[str, ...]:
    return LEGACY_KEY if legacy_key else FINDING_KEY


def with_id(findings: DataFrame, *columns: str, out: str = "id") -> DataFrame:
    """Deterministic id over the identity columns, so that a rerun writes the same ids."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return findings.withColumn(out, F.sha2(F.concat_ws("|", *parts), 256))


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in ``order`` (ascending column names)."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


_ENGINE_RANK = {"mcp": 0, "regex": 1, "entropy": 2}


def engine_rank(engine):
    rank = F.lit(len(_ENGINE_RANK))
    for name, value in _ENGINE_RANK.items():
        rank = F.when(engine == name, value).otherwise(rank)
    return rank


def merge_engines(*findings: DataFrame, scope=("scan_id",)) -> DataFrame:
    """Verified before regex, one finding per scope, path, start line and type."""
    ranked = union_all(*findings).withColumn("_rank", engine_rank(F.col("engine")))
    key = (*scope, "file_path", "line_start", "type")
    return first_per_key(ranked, key, ("_rank", "rule_ord", "match_ord")).drop("_rank")


def dedupe_commit(hits: DataFrame, legacy_key: bool = False) -> DataFrame:
    """First finding per fingerprint and path in a commit, regex before entropy, then line, rule and match order."""
    key = ("commit_sha", *finding_key(legacy_key))
    ranked = hits.withColumn("_rank", engine_rank(F.col("engine")))
    return first_per_key(ranked, key, ("_rank", "line_start", "rule_ord", "match_ord")).drop("_rank")


def suppress_regex_hits(candidates: DataFrame, regex_hits: DataFrame, file_key=("repo", "commit_sha", "file_path")) -> DataFrame:
    """Entropy candidates whose secret was not also found by a rule in the same file, compared by fingerprint."""
    key = [*file_key, "fingerprint"]
    return candidates.join(regex_hits.select(*key).distinct(), key, "left_anti")


def dedupe_and_suppress(hits: DataFrame, kept, legacy_key: bool = False) -> DataFrame:
    """Suppression and commit dedupe of one scan in one shuffle.

    ``hits`` holds regex and entropy rows of the same files and ``kept`` the condition that survives scoring. An
    entropy row is dropped when a rule found the same secret, whether or not the rule's row survived.
    """
    keys = ["commit_sha", *finding_key(legacy_key)]
    cols = [c for c in hits.columns if c not in keys]
    order = F.struct("line_start", "rule_ord", "match_ord")
    is_regex = F.col("engine") == "regex"
    row = F.struct(*cols)
    grouped = hits.groupBy(*keys).agg(
        F.min_by(F.when(kept & is_regex, row), F.when(kept & is_regex, order)).alias("_regex"),
        F.min_by(F.when(kept & ~is_regex, row), F.when(kept & ~is_regex, order)).alias("_entropy"),
        F.max(is_regex).alias("_has_regex"),
    )
    first = F.when(F.col("_has_regex"), F.col("_regex")).otherwise(F.col("_entropy"))
    return (
        grouped.withColumn("_first", first).where(F.col("_first").isNotNull())
        .select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in hits.columns])
    )


def sightings(findings: DataFrame, seen_at: str, legacy_key: bool = False) -> DataFrame:
    """Collapse a batch of findings to one row per key with first and last seen time and the first payload.

    A missing repository becomes ``unknown``, so that keys are never null.
    """
    keys = list(finding_key(legacy_key))
    if "repo" in findings.columns:
        findings = findings.withColumn("repo", F.coalesce("repo", F.lit("unknown")))
    rest = [c for c in findings.columns if c not in keys and c != seen_at]
    tie = [F.col(seen_at)] + [F.col(c) for c in ("commit_sha", "line_start") if c in rest]
    return findings.groupBy(*keys).agg(
        F.min(seen_at).alias("first_seen_at"),
        F.max(seen_at).alias("last_seen_at"),
        F.min_by(F.struct(*rest), F.struct(*tie)).alias("_first"),
    ).select(*keys, "first_seen_at", "last_seen_at", *[F.col(f"_first.{c}").alias(c) for c in rest])


def lifecycle(findings: DataFrame, seen_at: str = "seen_at", legacy_key: bool = False) -> DataFrame:
    """The whole history folded at once: same result as upserting it in time order."""
    return sightings(findings, seen_at, legacy_key).withColumn("status", F.lit("NEW"))


def fold_lifecycle(changes: DataFrame, legacy_key: bool = False) -> DataFrame:
    """One lifecycle row per key from rows of several batches: earliest payload, first and last time."""
    keys = list(finding_key(legacy_key))
    rest = [c for c in changes.columns if c not in (*keys, "first_seen_at", "last_seen_at", "_batch")]
    folded = changes.groupBy(*keys).agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.min_by(F.struct(*rest), F.struct("first_seen_at", "_batch")).alias("_first"),
    )
    return folded.select(*keys, "first_seen_at", "last_seen_at", *[F.col(f"_first.{c}").alias(c) for c in rest])


def upsert(snapshot: DataFrame, batch: DataFrame, seen_at: str = "seen_at", legacy_key: bool = False):
    """(new snapshot, new rows). Known keys get a later last_seen_at, unknown keys enter as NEW."""
    keys = list(finding_key(legacy_key))
    incoming = lifecycle(batch, seen_at, legacy_key)
    cols = snapshot.columns
    # Plain equality on the keys, so that the join uses the partitioning of the aggregation.
    joined = incoming.alias("n").join(snapshot.withColumn("_known", F.lit(True)).alias("o"), keys, "full_outer")

    def pick(c: str):
        if c in keys:
            return F.col(c)
        if c == "last_seen_at":
            return F.greatest("o.last_seen_at", "n.last_seen_at").alias(c)
        if c not in incoming.columns:
            return F.col(f"o.{c}").alias(c)
        return F.when(F.col("_known"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    merged = joined.select(*[pick(c) for c in cols])
    added = incoming.join(snapshot.select(*keys), keys, "left_anti")
    return merged, added


def not_stored(rows: DataFrame, history: DataFrame, keys, most: int = MOST_KEYS) -> DataFrame:
    """Rows whose key the history lacks; ``rows`` is read twice, so pass a stored table.

    The history stays where it is: 64-bit digests of the rows' keys are broadcast to it, and only its rows with one of them are
    shuffled and compared. A run with more than ``most`` keys is joined plainly.
    """
    keys = list(keys)
    digest = F.xxhash64(*keys).alias("_key")
    wanted = rows.select(digest).distinct()
    if wanted.limit(most + 1).count() > most:
        return rows.join(history.select(*keys), keys, "left_anti")
    touched = history.select(*keys, digest).join(F.broadcast(wanted), "_key", "left_semi").select(*keys)
    return rows.join(touched.distinct(), keys, "left_anti")


def insert_if_absent(snapshot: DataFrame, batch: DataFrame, seen_at: str = "seen_at", legacy_key: bool = False) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key; stored rows are left as they are."""
    keys = list(finding_key(legacy_key))
    return lifecycle(batch, seen_at, legacy_key).join(snapshot.select(*keys), keys, "left_anti")


def apply_updates(findings: DataFrame, updates: DataFrame, statuses=PATCH_STATUSES) -> tuple[DataFrame, DataFrame]:
    """(findings after the updates, rejected updates).

    Updates carry id, status, notes and ts. A null status or note leaves the value; of several updates the last that
    sets a value wins. last_seen_at becomes the time of the last update. An unknown status rejects its update.
    """
    if not set(statuses) <= set(STATUSES):
        raise ValueError(f"unknown status in {statuses}")
    valid = F.col("status").isNull() | F.col("status").isin(*statuses)
    order = F.struct("ts", F.coalesce("status", F.lit("")), F.coalesce("notes", F.lit("")))
    latest = updates.where(valid).groupBy("id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("_status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), order)).alias("_notes"),
        F.max("ts").alias("_ts"),
    )
    updated = findings.join(latest, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "notes": F.coalesce("_notes", "notes"),
        "last_seen_at": F.coalesce("_ts", "last_seen_at"),
    })
    rejected = updates.where(~valid).withColumn("reason", F.lit("invalid_status"))
    return updated.select(*findings.columns), rejected


def append_notes(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Writes remediation results: a note line each in time order is appended, the status follows the last outcome.

    Results carry id, action, message, success and, where a finding can have several, ts.
    """
    note = F.concat(F.lit("Remediation: "), F.col("action"), F.lit(" - "), F.col("message"))
    time = F.col("ts") if "ts" in results.columns else F.lit(None).cast("timestamp")
    ready = results.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(time.alias("t"), note.alias("note"), F.col("success").alias("ok")))).alias("_done")
    ).select("id", F.array_join("_done.note", "\n").alias("_note"), F.element_at("_done.ok", -1).alias("_success"))
    old = F.col("notes")
    appended = F.when(F.col("_note").isNull(), old).when(
        F.length(old) > 0, F.concat(old, F.lit("\n"), F.col("_note"))
    ).otherwise(F.col("_note"))
    status = F.when(F.col("_success").isNull(), F.col("status")).when(
        F.col("_success"), "RESOLVED"
    ).otherwise("ACKNOWLEDGED")
    return findings.join(ready, "id", "left").withColumns({"notes": appended, "status": status}).select(
        *findings.columns
    )
