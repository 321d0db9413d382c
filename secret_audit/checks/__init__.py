"""Registered queries over the given tables and their check SQL."""


def load():
    """Import every query module and return (queries, oracle SQL)."""
    from secret_audit.checks import queries_detect, queries_events, queries_files, queries_findings  # noqa: F401
    from secret_audit.checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
