"""Sizes, percentages and rounding."""

MIB = 1 << 20
GIB = 1 << 30


def round_binary(value: str, digits: int = 2) -> str:
    """Round the exact binary value half-even: 2.675 -> 2.67, 0.125 -> 0.12.

    ``round`` and ``bround`` work on the shortest decimal text of a double, so
    they see a tie in 2.675 where the stored number lies just below it. The
    number formatter looks at the stored value. It costs a string per row, so it
    is for per-table columns; per-file sizes use ``bytes_to_mb``.
    """
    return f"CAST(format_number(CAST({value} AS DOUBLE), '0.{'0' * digits}') AS DOUBLE)"


def bytes_to_mb(size: str) -> str:
    """MiB to 2 decimals, half-even; null gives 0.

    Whole bytes over 2^20 are exact in a double, and the nearest non-tie lies
    4.7e-9 away from a tie, so ``bround`` is exact up to sizes of about 90 TB.
    """
    return f"coalesce(bround(({size}) / {MIB}D, 2), 0D)"


def bytes_to_gb(size: str) -> str:
    """GiB to 2 decimals, half-even on the binary value; null gives 0."""
    return f"coalesce({round_binary(f'({size}) / {GIB}D')}, 0D)"


def percent_of(part: str, whole: str, digits: int = 2) -> str:
    """100 * part / whole; null when the whole is zero."""
    return round_binary(f"try_divide(({part}) * 100D, CAST({whole} AS DOUBLE))", digits)


def safe_divide(numerator: str, denominator: str, default: float = 0.0) -> str:
    """Quotient, or ``default`` where the denominator is zero."""
    quotient = f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))"
    return f"CASE WHEN ({denominator}) = 0 THEN {float(default)}D ELSE {quotient} END"


def digits_to_number(text: str) -> str:
    """Text made of digits only, as a whole number; other text is 0, missing text too.

    Decimal rather than bigint, so that sums of metrics cannot wrap or fail. More than
    28 digits are no size; they give null, so the commit has no bytes stated.
    """
    number = f"try_cast({text} AS DECIMAL(28, 0))"
    return f"CASE WHEN {text} RLIKE '^[0-9]+$' THEN {number} ELSE CAST(0 AS DECIMAL(28, 0)) END"
