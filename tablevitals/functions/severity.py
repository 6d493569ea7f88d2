"""Severity tiers and the health fold."""

from ..config import LayoutConfig

# Fixed values, worst first: the position is the sort order of issues.
SEVERITIES = ("critical", "high", "medium", "low", "none")

# Worst issue severity -> health of the table.
HEALTH = {"critical": "critical", "high": "warning", "medium": "needs_attention"}
HEALTHY = "healthy"
ERROR = "error"


def _cases(value: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN '{key}' THEN {result}" for key, result in pairs)
    return f"CASE {value} {whens} ELSE {default} END"


def severity_order(severity: str) -> str:
    """0 for critical up to 4 for none, 5 for anything else."""
    pairs = [(name, at) for at, name in enumerate(SEVERITIES)]
    return _cases(severity, pairs, str(len(SEVERITIES)))


def skew_severity(ratio: str, config: LayoutConfig) -> str:
    """Tier of an unrounded largest-to-median ratio; each limit is inclusive."""
    return (
        f"CASE WHEN ({ratio}) IS NULL OR ({ratio}) <= {config.skew_low_threshold}D THEN 'none' "
        f"WHEN ({ratio}) <= {config.skew_medium_threshold}D THEN 'low' "
        f"WHEN ({ratio}) <= {config.skew_high_threshold}D THEN 'medium' ELSE 'high' END"
    )


def health_status(worst: str) -> str:
    """Health from the worst severity of a table; null when it has no issue."""
    return _cases(worst, [(s, f"'{h}'") for s, h in HEALTH.items()], f"'{HEALTHY}'")
