"""File layout: statistics, size bands, skew, and the fallback without a listing."""

from pyspark.sql import DataFrame

from ..config import LayoutConfig
from ..functions import percent_of, ratio_text, round_binary, skew_severity
from ..functions.numbers import MIB
from ..schemas import KEY
from .sizes import size_histogram, size_summary

LAYOUT_COLUMNS = (
    "total_files",
    "total_size_bytes",
    "avg_file_size_bytes",
    "avg_file_size_mb",
    "median_file_size_mb",
    "min_file_size_mb",
    "max_file_size_mb",
    "std_dev_mb",
)
BAND_COLUMNS = (
    "small_files_count",
    "small_files_pct",
    "severe_small_files_count",
    "severe_small_files_pct",
    "optimal_files_count",
    "optimal_files_pct",
)
SKEW_COLUMNS = (
    "file_skew_ratio",
    "has_file_skew",
    "file_skew_severity",
    "coefficient_of_variation",
    "skew_description",
    "skew_error",
)


def size_bands(config: LayoutConfig) -> dict[str, str]:
    """The size bands as conditions on exact bytes."""
    severe, acceptable = config.small_file_severe_mb * MIB, config.small_file_acceptable_mb * MIB
    smallest, largest = config.optimal_file_size_min_mb * MIB, config.optimal_file_size_max_mb * MIB
    return {
        "severe_small_files_count": f"size_bytes < {severe:.0f}L",
        "small_files_count": f"size_bytes < {acceptable:.0f}L",
        "optimal_files_count": f"size_bytes BETWEEN {smallest:.0f}L AND {largest:.0f}L",
    }


def file_profile(files: DataFrame, config: LayoutConfig) -> DataFrame:
    """All listing-based figures of every table, from one pass over the files."""
    bands = size_bands(config)
    summary = size_summary(size_histogram(files, **bands), *bands)
    return summary.selectExpr(*KEY, *profile_figures(config))


def profile_figures(config: LayoutConfig) -> list[str]:
    """The figures of ``file_profile`` over the columns of a size summary with its bands."""
    bands = size_bands(config)
    ratio = "CASE WHEN n >= 2 AND median_mb > 0 THEN max_mb / median_mb ELSE 0D END"
    variation = "CASE WHEN n >= 2 AND mean_mb > 0 THEN stddev_mb / mean_mb * 100D ELSE 0D END"
    # Tiers look at the unrounded ratio.
    severity = skew_severity(ratio, config)
    shown = f"concat(' (largest file is ', {ratio_text(ratio)}, ' times the median)')"
    return [
        "n AS total_files",
        "bytes AS total_size_bytes",
        "CAST(bytes AS DOUBLE) / CAST(n AS DOUBLE) AS avg_file_size_bytes",
        f"{round_binary('mean_mb')} AS avg_file_size_mb",
        f"{round_binary('median_mb')} AS median_file_size_mb",
        "min_mb AS min_file_size_mb",
        "max_mb AS max_file_size_mb",
        f"{round_binary('stddev_mb')} AS std_dev_mb",
        *bands,
        *[f"{percent_of(b, 'n')} AS {b.replace('_count', '_pct')}" for b in bands],
        f"{round_binary(ratio)} AS file_skew_ratio",
        f"{ratio} > {config.file_skew_threshold}D AS has_file_skew",
        f"{severity} AS file_skew_severity",
        f"{round_binary(variation)} AS coefficient_of_variation",
        f"""CASE {severity} WHEN 'none' THEN 'file sizes are even'
            WHEN 'low' THEN concat('slightly uneven file sizes', {shown})
            WHEN 'medium' THEN concat('uneven file sizes', {shown})
            ELSE concat('very uneven file sizes', {shown}) END AS skew_description""",
        "CASE WHEN n < 2 THEN 'fewer than two files' END AS skew_error",
    ]


def file_layout(files: DataFrame, config: LayoutConfig) -> DataFrame:
    """Count, bytes, mean, median, min, max and deviation of file sizes."""
    return file_profile(files, config).select(*KEY, *LAYOUT_COLUMNS)


def file_size_bands(files: DataFrame, config: LayoutConfig) -> DataFrame:
    """Counts and shares of severely small, small and optimal files (exact bytes)."""
    return file_profile(files, config).select(*KEY, "total_files", *BAND_COLUMNS)


def file_skew(files: DataFrame, config: LayoutConfig) -> DataFrame:
    """Largest-to-median ratio, its tier, and the coefficient of variation."""
    return file_profile(files, config).select(*KEY, *SKEW_COLUMNS)


def layout_with_fallback(detail: DataFrame, profile: DataFrame, config: LayoutConfig) -> DataFrame:
    """One layout row per table of ``detail`` (the output of ``table_detail``)."""
    joined = detail.select(*KEY, "location", "num_files", "table_size_bytes").join(
        profile, list(KEY), "left"
    )
    figures = layout_figures(config)
    return joined.selectExpr(*KEY, *[f"{text} AS {name}" for name, text in figures.items()])


def layout_figures(config: LayoutConfig) -> dict[str, str]:
    """Layout columns over a detail row with its (maybe missing) file profile.

    ``layout_source`` tells where the figures come from: the listing; the detail
    averages when no file of the table was listed; nothing when the detail row
    says there are no files or has no location. Detail averages know no spread,
    so they give no skew, and they make all files small or none.
    """
    has_files = "location IS NOT NULL AND num_files > 0"
    listed = f"{has_files} AND total_files IS NOT NULL"
    avg_bytes = "try_divide(CAST(table_size_bytes AS DOUBLE), CAST(num_files AS DOUBLE))"
    avg_mb = round_binary(f"{avg_bytes} / {MIB}D")

    def below(limit_mb: float) -> str:
        return f"CASE WHEN {avg_mb} < {limit_mb}D THEN 100D ELSE 0D END"

    estimates = {
        "total_files": "num_files",
        "total_size_bytes": "table_size_bytes",
        "avg_file_size_bytes": avg_bytes,
        "avg_file_size_mb": avg_mb,
        "median_file_size_mb": avg_mb,
        "small_files_pct": below(config.small_file_acceptable_mb),
        "severe_small_files_pct": below(config.small_file_severe_mb),
    }

    def figure(name: str, default: str) -> str:
        estimate = f"WHEN {has_files} THEN {estimates[name]}" if name in estimates else ""
        return f"CASE WHEN {listed} THEN {name} {estimate} ELSE {default} END"

    defaults = {name: "0" for name in LAYOUT_COLUMNS + BAND_COLUMNS}
    defaults |= {"file_skew_ratio": "0D", "has_file_skew": "false", "file_skew_severity": "'none'"}
    defaults["coefficient_of_variation"] = "0D"
    return {
        "layout_source": f"CASE WHEN {listed} THEN 'listing' WHEN {has_files} THEN 'detail' ELSE 'none' END",
        **{name: figure(name, default) for name, default in defaults.items()},
        "skew_description": f"CASE WHEN {listed} THEN skew_description END",
        "skew_error": f"CASE WHEN {listed} THEN skew_error WHEN {has_files} THEN 'no file listing' END",
    }
