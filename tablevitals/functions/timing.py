"""Ages and time text. Timestamps are compared in the session time zone."""

from datetime import datetime

_DAY_MICROS = 86_400_000_000


def moment(when: datetime) -> str:
    """A point in time; one without an offset is read in the session time zone."""
    return f"TIMESTAMP '{when.isoformat(sep=' ')}'"


def floor_days(later: str, earlier: str) -> str:
    """Completed 24-hour periods between two timestamps; negative before zero.

    Not ``datediff``, which counts calendar days.
    """
    micros = f"(unix_micros({later}) - unix_micros({earlier}))"
    return f"CAST(({micros} - pmod({micros}, {_DAY_MICROS}L)) DIV {_DAY_MICROS}L AS INT)"


def age_text(days: str, never: str = "Never") -> str:
    # These words are stored in saved reports.
    return (
        f"CASE WHEN {days} IS NULL THEN '{never}' WHEN {days} = 0 THEN 'Today' "
        f"WHEN {days} = 1 THEN 'Yesterday' ELSE concat({days}, ' days ago') END"
    )


def iso_text(ts: str) -> str:
    """ISO-8601 text; the fraction appears only when it is not zero."""
    return (
        f"concat(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"), "
        f"CASE WHEN pmod(unix_micros({ts}), 1000000L) = 0 THEN '' ELSE date_format({ts}, '.SSSSSS') END)"
    )


def weekday_name(ts: str) -> str:
    return f"date_format({ts}, 'EEEE')"
