"""Which action a finding calls for. Plans only: nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Action and message per kind.
ACTIONS = {
    "aws_access_key": ("disable", "Disable the access key"),
    "aws_secret_key": ("manual_required", "Cannot remediate secret key without access key ID"),
}


def default_routes(spark) -> DataFrame:
    rows = [(kind, "aws_remediation", 1) for kind in ACTIONS]
    return spark.createDataFrame(rows, "type string, handler string, priority int")


def first_handlers(routes: DataFrame) -> DataFrame:
    """The first capable handler per kind."""
    return routes.groupBy("type").agg(F.min_by("handler", F.struct("priority", "handler")).alias("handler"))


def route(findings: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds the handler of the finding's kind, null without one."""
    return findings.join(first_handlers(routes), "type", "left")


def remediation_plan(findings: DataFrame) -> DataFrame:
    """Adds action, message and the status that success or failure leads to."""
    kind = F.col("type")
    action, message = F.lit("none"), F.concat(F.lit("No remediation available for "), kind)
    for name, (a, m) in ACTIONS.items():
        action = F.when(kind == name, a).otherwise(action)
        message = F.when(kind == name, m).otherwise(message)
    planned = kind.isin(*ACTIONS)
    return findings.withColumns({
        "action": action,
        "message": message,
        "status_on_success": F.when(planned, "RESOLVED").otherwise(F.col("status")),
        "status_on_failure": F.when(planned, "ACKNOWLEDGED").otherwise(F.col("status")),
    })
