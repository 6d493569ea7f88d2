"""The registered queries as DuckDB SQL, written from the definitions.

Literals are doubles (``1048576e0``): a bare ``2.5`` is a DECIMAL in DuckDB.
``printf('%.2f')`` rounds the stored binary value half-even.
"""

from __future__ import annotations

KEYS = "'lake' AS catalog, 'main' AS schema, tbl AS \"table\""


def rnd(x: str, digits: int = 2) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def mb(x: str) -> str:
    return f"round_even(({x}) / 1048576e0, 2)"


def gb(x: str) -> str:
    return rnd(f"({x}) / 1073741824e0")


def iso(x: str) -> str:
    whole = f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"
    return f"CASE WHEN epoch_us({x}) % 1000000 = 0 THEN {whole} ELSE {whole} || strftime({x}, '.%f') END"


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS INTEGER)"


def age(x: str, never: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '{never}' WHEN {x} = 0 THEN 'Today' "
        f"WHEN {x} = 1 THEN 'Yesterday' ELSE {x} || ' days ago' END"
    )


def tier(x: str) -> str:
    return f"CASE WHEN {x} <= 3e0 THEN 'none' WHEN {x} <= 5e0 THEN 'low' WHEN {x} <= 10e0 THEN 'medium' ELSE 'high' END"


def grouped(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def counted(x: str) -> str:
    return f"format('{{:,}}', {x})"


def middle(values: str) -> str:
    """Median of a list: the mean of its middle pair."""
    s = f"list_sort({values})"
    n = f"len({values})"
    return f"({s}[({n} + 1) // 2] + {s}[{n} // 2 + 1]) / 2e0"


def mean(x: str) -> str:
    """Exact mean of doubles of at least 0.01: each is a whole number of 2^-59."""
    units = f"CAST(floor({x}) AS HUGEINT) * 576460752303423488 + CAST(({x} - floor({x})) * 576460752303423488e0 AS HUGEINT)"
    total, n = f"(4 * CAST(sum({units}) AS HUGEINT))", f"count({x})"
    odd = f"CASE WHEN {total} % {n} > 0 AND ({total} // {n}) % 2 = 0 THEN 1 ELSE 0 END"
    return f"CASE WHEN {n} > 0 THEN CAST({total} // {n} + {odd} AS DOUBLE) / 2305843009213693952e0 END"


# Inputs --------------------------------------------------------------------

FILES = """
files AS (
  SELECT source AS tbl, lang AS part,
    CASE CAST(substr(source, 4) AS INT) % 4
      WHEN 0 THEN n_chars * 8000 WHEN 1 THEN n_chars * 60000
      WHEN 2 THEN 400000000 + n_chars * 20000 ELSE 60000000 + n_chars * 60000 END AS size
  FROM documents)"""

PARTS = """
files AS (
  SELECT 'src' || (l_suppkey % 20) AS tbl, CAST(l_orderkey AS VARCHAR) AS part,
    CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS size
  FROM lineitem)"""

DETAIL = f"""
raw AS (SELECT tbl, CAST(substr(tbl, 4) AS INT) AS k, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS bytes
  FROM files GROUP BY tbl),
detail AS (
  SELECT tbl, k, num_files, CAST(bytes * (4 ** (k % 5)) AS BIGINT) AS bytes,
    k <> 19 AS is_valid, k % 2 = 0 AS partitioned,
    CASE WHEN k = 19 THEN 'iceberg' ELSE 'delta' END AS format,
    CASE WHEN k = 19 THEN 'unsupported table format: iceberg' END AS error
  FROM raw),
sized AS (SELECT *, {gb("bytes")} AS size_gb FROM detail)"""

PROFILE = f"""
per AS (SELECT tbl, size, {mb("size")} AS m FROM files),
stats AS (
  SELECT tbl, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(m) AS lo, max(m) AS hi,
    {mean("m")} AS mean,
    {middle("list(m)")} AS med, coalesce(stddev_samp(m), 0e0) AS sd,
    count(*) FILTER (size < 32 * 1048576) AS severe,
    count(*) FILTER (size < 128 * 1048576) AS small,
    count(*) FILTER (size BETWEEN 512 * 1048576 AND 1024 * 1048576) AS optimal
  FROM per GROUP BY tbl),
ratios AS (
  SELECT *, CASE WHEN n >= 2 AND med > 0 THEN hi / med ELSE 0e0 END AS ratio,
    CASE WHEN n >= 2 AND mean > 0 THEN sd / mean * 100e0 ELSE 0e0 END AS cv FROM stats),
prof AS (
  SELECT tbl, n AS total_files, bytes AS total_size_bytes, bytes / CAST(n AS DOUBLE) AS avg_file_size_bytes,
    {rnd("mean")} AS avg_file_size_mb, {rnd("med")} AS median_file_size_mb,
    lo AS min_file_size_mb, hi AS max_file_size_mb, {rnd("sd")} AS std_dev_mb,
    small AS small_files_count, {rnd("small * 100e0 / n")} AS small_files_pct,
    severe AS severe_small_files_count, {rnd("severe * 100e0 / n")} AS severe_small_files_pct,
    optimal AS optimal_files_count, {rnd("optimal * 100e0 / n")} AS optimal_files_pct,
    {rnd("ratio")} AS file_skew_ratio, ratio > 10e0 AS has_file_skew, {tier("ratio")} AS file_skew_severity,
    {rnd("cv")} AS coefficient_of_variation,
    CASE {tier("ratio")} WHEN 'none' THEN 'file sizes are even'
      WHEN 'low' THEN 'slightly uneven file sizes' WHEN 'medium' THEN 'uneven file sizes'
      ELSE 'very uneven file sizes' END ||
    CASE WHEN ratio <= 3e0 THEN '' ELSE ' (largest file is ' || printf('%.1f', ratio) || ' times the median)' END
      AS skew_description
  FROM ratios)"""

BALANCE = f"""
psize AS (SELECT tbl, part, CAST(sum(size) AS BIGINT) AS size FROM files WHERE part IS NOT NULL GROUP BY tbl, part),
pmb AS (SELECT tbl, CASE WHEN size > 0 THEN {mb("size")} END AS m FROM psize),
pstat AS (
  SELECT tbl, CAST(count(*) AS INTEGER) AS n, max(m) AS hi, min(m) AS lo,
    {middle("(list(m) FILTER (m IS NOT NULL))")} AS med,
    {mean("m")} AS mean
  FROM pmb GROUP BY tbl)"""


def balance(threshold: str) -> str:
    """Partition figures of ``based`` rows (tbl, bytes, partitioned)."""
    return f"""
joined AS (
  SELECT b.tbl, b.partitioned, CASE WHEN b.partitioned THEN coalesce(p.n, 0) ELSE 0 END AS n,
    b.bytes, p.hi, p.lo, p.med, p.mean
  FROM based b LEFT JOIN pstat p USING (tbl)),
measured AS (
  SELECT *, n > 0 AS fits,
    CASE WHEN n > 0 THEN {mb("CAST(bytes AS BIGINT) // n")} ELSE 0e0 END AS even FROM joined),
filled AS (
  SELECT *, CASE WHEN NOT fits THEN 0e0 ELSE coalesce({rnd("hi")}, even) END AS largest,
    CASE WHEN NOT fits THEN 0e0 ELSE coalesce({rnd("lo")}, even) END AS smallest,
    CASE WHEN NOT fits THEN 0e0 ELSE coalesce({rnd("med")}, even) END AS median,
    CASE WHEN NOT fits THEN 0e0 ELSE coalesce({rnd("mean")}, even) END AS average FROM measured),
bal AS (
  SELECT tbl, partitioned AS is_partitioned, n AS partition_count, largest AS largest_partition_size_mb,
    smallest AS smallest_partition_size_mb, median AS median_partition_size_mb, average AS avg_partition_size_mb,
    fits AND med IS NULL AS partition_sizes_estimated,
    CASE WHEN median > 0 THEN largest / median ELSE 0e0 END AS ratio,
    {rnd("CASE WHEN median > 0 THEN largest / median ELSE 0e0 END")} AS partition_skew_ratio,
    {tier("(CASE WHEN median > 0 THEN largest / median ELSE 0e0 END)")} AS partition_skew_severity,
    CASE WHEN median > 0 THEN largest / median ELSE 0e0 END > {threshold} AS has_partition_skew
  FROM filled)"""


HISTORY = """
hist AS (
  SELECT 'src' || k AS tbl, event_id AS version, ts, operation AS op, event_id, value, zorder,
    CASE WHEN event_id % 10 IN (0, 5) THEN 0 WHEN event_id % 10 = 7 THEN NULL
      ELSE CAST(floor(value * 1000000) AS HUGEINT) END AS written,
    event_type = 'purchase' AND op_kept AND event_id % 7 = 0 AS has_predicate
  FROM (SELECT *, user_id % 20 AS k,
      NOT (event_type = 'purchase' AND user_id % 20 IN (0, 7)) AND NOT (event_type = 'error' AND user_id % 20 IN (3, 7))
        AND NOT (event_type IN ('purchase', 'error') AND user_id % 20 IN (1, 5, 9) AND ts >= TIMESTAMP '2024-01-06')
        AS op_kept,
      CASE WHEN event_type = 'view' OR NOT op_kept THEN 'WRITE' WHEN event_type = 'signup' THEN 'MERGE'
        WHEN event_type = 'purchase' THEN 'OPTIMIZE'
        WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'VACUUM START'
        WHEN event_type = 'error' THEN 'VACUUM END'
        WHEN event_id % 2 = 0 THEN 'DELETE' ELSE 'STREAMING UPDATE' END AS operation,
      CASE event_id % 3 WHEN 0 THEN '["c1","c2"]' WHEN 1 THEN '[]' ELSE 'c3, c4' END AS zorder
    FROM events))"""

RECENT = HISTORY + ",\nrecent AS (SELECT * FROM hist)"
NEWEST = HISTORY + """,
recent AS (
  SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY version DESC) <= 100)"""

PIVOT = """
pivot_ops AS (
  SELECT tbl, count(*) AS total_commits,
    count(*) FILTER (op = 'WRITE') AS write_count, count(*) FILTER (op = 'OPTIMIZE') AS optimize_count,
    count(*) FILTER (op IN ('VACUUM START', 'VACUUM END')) AS vacuum_count,
    count(*) FILTER (op = 'MERGE') AS merge_count, count(*) FILTER (op = 'DELETE') AS delete_count,
    count(*) FILTER (op = 'UPDATE') AS update_count
  FROM recent GROUP BY tbl)"""

LAST = """
last_ops AS (
  SELECT tbl, max(ts) FILTER (contains(op, 'WRITE')) AS last_write,
    max(ts) FILTER (contains(op, 'OPTIMIZE')) AS last_optimize,
    max(ts) FILTER (contains(op, 'VACUUM END')) AS last_vacuum_end,
    max(ts) FILTER (contains(op, 'VACUUM START')) AS last_vacuum_start,
    max(ts) FILTER (contains(op, 'MERGE')) AS last_merge,
    max(ts) FILTER (contains(op, 'DELETE')) AS last_delete,
    max(ts) FILTER (contains(op, 'UPDATE')) AS last_update
  FROM recent GROUP BY tbl)"""

AS_OF = "TIMESTAMP '2024-02-15 00:00:00'"


def status(as_of: str = AS_OF) -> str:
    vacuum = "coalesce(last_vacuum_end, last_vacuum_start)"
    return f"""
status AS (
  SELECT *, {age("days_since_last_optimize", "Never run")} AS optimize_status,
    {age("days_since_last_vacuum", "Never run")} AS vacuum_status
  FROM (SELECT tbl, last_write, last_optimize, {vacuum} AS last_vacuum, last_merge,
      {days(as_of, "last_write")} AS days_since_last_write,
      {days(as_of, "last_optimize")} AS days_since_last_optimize,
      {days(as_of, vacuum)} AS days_since_last_vacuum
    FROM last_ops))"""


CADENCE = f"""
gaps AS (
  SELECT tbl, ts, has_predicate, {days("ts", "lead(ts) OVER (PARTITION BY tbl ORDER BY ts DESC)")} AS gap
  FROM recent WHERE op = 'OPTIMIZE'),
cadence AS (
  SELECT tbl, count(*) AS optimize_count, max(ts) AS last_ts, count(*) FILTER (has_predicate) AS predicates,
    {rnd("CASE WHEN count(gap) > 0 THEN sum(gap) / CAST(count(gap) AS DOUBLE) END", 1)} AS optimize_frequency_days
  FROM gaps GROUP BY tbl),
znames AS (
  SELECT DISTINCT tbl, unnest(CASE event_id % 3 WHEN 0 THEN ['c1', 'c2'] WHEN 1 THEN [] ELSE ['c3', 'c4'] END) AS name
  FROM recent WHERE op = 'OPTIMIZE'),
zcols AS (SELECT tbl, list(name ORDER BY name) AS zorder_columns FROM znames GROUP BY tbl)"""

GROWTH = f"""
writes AS (
  SELECT tbl, count(*) AS n, CAST(sum(written) AS DOUBLE) AS bytes_written, CAST(count(written) AS DOUBLE) AS with_metrics,
    CAST(greatest({days("max(ts)", "min(ts)")}, 1) AS DOUBLE) AS span
  FROM recent WHERE op IN ('WRITE', 'MERGE', 'UPDATE', 'DELETE') GROUP BY tbl),
weekdays AS (
  SELECT tbl, dayname(ts) AS weekday, count(*) AS n, max(version) AS newest
  FROM recent WHERE op IN ('WRITE', 'MERGE', 'UPDATE', 'DELETE') GROUP BY tbl, dayname(ts)),
busiest AS (
  SELECT tbl, weekday AS busiest_day FROM weekdays
  QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n DESC, newest DESC) = 1),
grow AS (
  SELECT w.tbl, w.n AS mutating_commits,
    CASE WHEN w.n >= 2 THEN {rnd("w.n / span")} ELSE 0e0 END AS daily_write_count,
    {rnd("bytes_written / with_metrics / 1048576e0")} AS avg_write_size_mb,
    CASE WHEN w.n >= 2 THEN {rnd("bytes_written / span / 1048576e0")} ELSE 0e0 END AS estimated_daily_growth_mb,
    CASE WHEN w.n >= 2 AND d.bytes > 0
      THEN {rnd("100e0 * (bytes_written / span) / CAST(d.bytes AS DOUBLE)", 4)} ELSE 0e0 END AS growth_rate_pct_daily,
    CASE WHEN w.n >= 2 THEN b.busiest_day END AS busiest_day
  FROM writes w LEFT JOIN detail d USING (tbl) LEFT JOIN busiest b USING (tbl))"""

CLUSTERING = """
clus AS (
  SELECT tbl, k % 3 <> 2 AS is_liquid_clustered,
    CASE k % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['c'] ELSE CAST([] AS VARCHAR[]) END AS clustering_columns
  FROM (SELECT DISTINCT source AS tbl, CAST(substr(source, 4) AS INT) AS k FROM documents))"""

NAME = "'`lake`.`main`.`' || tbl || '`'"


def _compact(zcols: str = "zorder_columns") -> str:
    ordered = f"' ZORDER BY (' || list_aggregate(list_transform({zcols}, lambda c: '`' || c || '`'), 'string_agg', ', ') || ')'"
    return f"'OPTIMIZE ' || {NAME} || CASE WHEN len({zcols}) > 0 THEN {ordered} ELSE '' END || ';'"


# (rule, id, category, severity, condition, title, details, current, threshold, recommendation, statement)
_FILES = f"{counted('num_files')} || ' files of ' || {grouped('avg_file_size_mb')} || ' MB on average; '"
_SMALL = "num_files > 0 AND avg_file_size_mb > 0"
_CRITICAL = "(avg_file_size_mb < 32 OR severe_small_files_pct > 50)"
_VACUUM = f"'VACUUM ' || {NAME} || ' RETAIN 168 HOURS;'"
_SKETCH = (
    f"'-- Choose the column, then run without the dashes:' || chr(10) || '-- CREATE TABLE ' || '`lake`.`main`.`' || tbl || "
    f"'_by_column` PARTITIONED BY (chosen_column) AS SELECT * FROM ' || {NAME} || ';'"
)
_PARTS = f"{counted('partition_count')} || ' partitions"
RULES = (
    (1, "'SMALL_FILES_CRITICAL'", "small_files", "'critical'", f"{_SMALL} AND {_CRITICAL}",
     "'Most files are far too small'",
     f"{_FILES} || {grouped('severe_small_files_pct')} || '% are under 32 MB and ' || {grouped('small_files_pct')} || '% under 128 MB'",
     f"{grouped('avg_file_size_mb')} || ' MB average, ' || {grouped('severe_small_files_pct')} || '% under 32 MB'",
     "'average of 32 MB or more, at most 50% under 32 MB'",
     "'Compact the table now, then write larger batches so that it stays compact.'",
     f"'OPTIMIZE ' || {NAME} || ';'"),
    (1, "'SMALL_FILES_WARNING'", "small_files", "'medium'",
     f"{_SMALL} AND NOT {_CRITICAL} AND (avg_file_size_mb < 128 OR small_files_pct > 20)",
     "'Many files are small'",
     f"{_FILES} || {grouped('small_files_pct')} || '% are under 128 MB'",
     f"{grouped('avg_file_size_mb')} || ' MB average, ' || {grouped('small_files_pct')} || '% under 128 MB'",
     "'average of 128 MB or more, at most 20% under 128 MB'",
     "'Compact the table and put compaction on a schedule.'",
     f"'OPTIMIZE ' || {NAME} || ';'"),
    (2, "'FILE_SKEW_' || upper(file_skew_severity)", "file_skew", "file_skew_severity",
     "file_skew_severity <> 'none'",
     "'File sizes are uneven (' || upper(file_skew_severity[1]) || file_skew_severity[2:] || ')'",
     f"'Largest file ' || {grouped('max_file_size_mb')} || ' MB, median ' || {grouped('median_file_size_mb')} || "
     f"' MB, smallest ' || {grouped('min_file_size_mb')} || ' MB; coefficient of variation ' || {grouped('coefficient_of_variation')} || '%'",
     f"'largest file is ' || {grouped('file_skew_ratio')} || ' times the median'",
     "'at most 3 times'",
     "'Look at how the table is written, and spread rows evenly over tasks before writing.'", "NULL"),
    (3, "'OPTIMIZE_NEVER_RUN'", "stale_optimize", "'high'", "days_since_last_optimize IS NULL",
     "'Never compacted'", "'No OPTIMIZE is found in the commits looked at.'", "'never'",
     "'optimized within 30 days'", "'Compact the table and put compaction on a schedule.'", _compact()),
    (3, "'OPTIMIZE_STALE'", "stale_optimize", "'medium'", "days_since_last_optimize > 30",
     "'Compaction is overdue'", "'The last OPTIMIZE is ' || days_since_last_optimize || ' days old.'",
     "days_since_last_optimize || ' days ago'", "'optimized within 30 days'",
     "'Compact the table, and do so more often.'", _compact()),
    (4, "'VACUUM_NEVER_RUN'", "stale_vacuum", "'medium'", "days_since_last_vacuum IS NULL",
     "'Never vacuumed'", "'No VACUUM is found in the commits looked at.'", "'never'", "'vacuumed within 30 days'",
     "'Vacuum the table to free the space of files no longer in use, and repeat it on a schedule.'", _VACUUM),
    (4, "'VACUUM_STALE'", "stale_vacuum", "'low'", "days_since_last_vacuum > 30",
     "'Vacuum is overdue'", "'The last VACUUM is ' || days_since_last_vacuum || ' days old.'",
     "days_since_last_vacuum || ' days ago'", "'vacuumed within 30 days'",
     "'Vacuum the table to free the space of files no longer in use.'", _VACUUM),
    (5, "'LARGE_TABLE_NO_PARTITION'", "no_partitioning", "'high'", "size_gb >= 1000 AND NOT is_partitioned",
     "'Large table without partitions'",
     f"'The table holds ' || {grouped('size_gb')} || ' GB in one unpartitioned set of files.'",
     f"{grouped('size_gb')} || ' GB, not partitioned'", "'partitioned from 1000 GB'",
     "'Recreate the table partitioned by a column that queries filter on, such as a date.'", _SKETCH),
    (6, "'NO_LIQUID_CLUSTERING'", "no_liquid_clustering", "'medium'",
     "size_gb > 10 AND size_gb < 1000 AND NOT is_liquid_clustered",
     "'No clustering columns'",
     f"'The table holds ' || {grouped('size_gb')} || ' GB and has no clustering columns.'",
     "'not clustered'", "'clustered from 10 GB to 1000 GB'",
     "'Cluster the table by the columns that queries filter on.'",
     f"'ALTER TABLE ' || {NAME} || ' CLUSTER BY (first_filter_column, second_filter_column);'"),
    (7, "'NO_ZORDER'", "no_zorder", "'medium'",
     "size_gb > 500 AND len(zorder_columns) = 0 AND NOT is_liquid_clustered",
     "'Large table that was never z-ordered'",
     f"'The table holds ' || {grouped('size_gb')} || ' GB and no commit looked at z-ordered it.'",
     "'no z-order columns'", "'z-ordered or clustered above 500 GB'",
     "'Z-order the table by the columns that queries filter on, or cluster it by them.'",
     f"'OPTIMIZE ' || {NAME} || ' ZORDER BY (first_filter_column, second_filter_column);'"),
    (8, "'EXCESS_PARTITIONS'", "excess_partitions", "'critical'", "partition_count > 5000",
     "'Too many partitions'", f"{_PARTS} by lang'", f"{_PARTS}'", "'at most 5,000 partitions'",
     "'Partition by fewer columns or by a coarser one, such as month instead of day.'", "NULL"),
    (8, "'HIGH_PARTITION_COUNT'", "excess_partitions", "'medium'",
     "partition_count <= 5000 AND partition_count > 4000",
     "'Partition count nears its limit'", f"{_PARTS} by lang'", f"{_PARTS}'", "'at most 5,000 partitions'",
     "'Watch the partition count, and plan a coarser partitioning if it keeps rising.'", "NULL"),
    (9, "'PARTITION_SKEW_' || upper(partition_skew_severity)", "partition_skew", "partition_skew_severity",
     "has_partition_skew AND partition_skew_severity <> 'none'",
     "'Partition sizes are uneven (' || upper(partition_skew_severity[1]) || partition_skew_severity[2:] || ')'",
     f"'Largest partition ' || {grouped('largest_partition_size_mb')} || ' MB, median ' || "
     f"{grouped('median_partition_size_mb')} || ' MB, smallest ' || {grouped('smallest_partition_size_mb')} || ' MB'",
     f"'largest partition is ' || {grouped('partition_skew_ratio')} || ' times the median'",
     "'at most 3 times'",
     "'Partition by a column, or a function of it, that spreads rows more evenly.'", "NULL"),
)


def rule_rows(rules=RULES, source: str = "metrics") -> str:
    selects = []
    for no, ident, category, severity, cond, title, details, current, threshold, advice, statement in rules:
        selects.append(
            f"SELECT tbl, {no} AS rule_no, {ident} AS issue_id, '{category}' AS category, {severity} AS severity, "
            f"{title} AS title, {details} AS details, {current} AS current_value, {threshold} AS threshold, "
            f"{advice} AS recommendation, CAST({statement} AS VARCHAR) AS sql_command "
            f"FROM {source} WHERE is_valid AND {cond}"
        )
    return "\n UNION ALL ".join(selects)


BASED = "\nbased AS (SELECT tbl, bytes, partitioned FROM detail)"


METRICS = """
metrics AS (
  SELECT d.*, p.* EXCLUDE (tbl), b.* EXCLUDE (tbl, ratio), coalesce(c.is_liquid_clustered, false) AS is_liquid_clustered,
    coalesce(c.clustering_columns, CAST([] AS VARCHAR[])) AS clustering_columns,
    o.tbl IS NOT NULL AS history_available, coalesce(o.total_commits, 0) AS total_commits,
    coalesce(o.vacuum_count, 0) AS vacuum_count, s.* EXCLUDE (tbl, optimize_status, vacuum_status),
    coalesce(s.optimize_status, 'Never run') AS optimize_status,
    coalesce(s.vacuum_status, 'Never run') AS vacuum_status,
    coalesce(z.zorder_columns, CAST([] AS VARCHAR[])) AS zorder_columns,
    coalesce(o.optimize_count, 0) AS zorder_usage_count, a.optimize_frequency_days,
    coalesce(g.daily_write_count, 0e0) AS daily_write_count, coalesce(g.avg_write_size_mb, 0e0) AS avg_write_size_mb,
    coalesce(g.growth_rate_pct_daily, 0e0) AS growth_rate_pct_daily, g.busiest_day
  FROM sized d JOIN prof p USING (tbl) JOIN bal b USING (tbl) LEFT JOIN clus c USING (tbl)
    LEFT JOIN pivot_ops o USING (tbl) LEFT JOIN status s USING (tbl) LEFT JOIN zcols z USING (tbl)
    LEFT JOIN cadence a USING (tbl) LEFT JOIN grow g USING (tbl))"""


def metrics(as_of: str = AS_OF) -> list[str]:
    return [
        FILES, DETAIL, PROFILE, BALANCE, BASED, balance("3e0"), RECENT, PIVOT, LAST, status(as_of), CADENCE,
        GROWTH, CLUSTERING, METRICS,
    ]


def worst_first(severity: str = "severity") -> str:
    return f"CASE {severity} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


# No rule says that something was never done where its source failed.
_SOURCES = {
    "'OPTIMIZE_NEVER_RUN'": " AND history_error IS NULL",
    "'VACUUM_NEVER_RUN'": " AND history_error IS NULL",
    "'NO_LIQUID_CLUSTERING'": " AND ddl_error IS NULL",
    "'NO_ZORDER'": " AND history_error IS NULL AND ddl_error IS NULL",
}
CERTAIN = tuple((*rule[:4], f"({rule[4]}){_SOURCES.get(rule[1], '')}", *rule[5:]) for rule in RULES)


def issue_ids(rules, source: str) -> list[str]:
    """The ids of each table's issues, worst first, as ``raised`` (tbl, issue_ids)."""
    return [
        f"\nfound AS ({rule_rows(rules, source)})",
        f"""
raised AS (SELECT tbl, string_agg(issue_id, ',' ORDER BY {worst_first()}, rule_no) AS issue_ids FROM found GROUP BY tbl)""",
    ]


_NUM = "CAST(substr(tbl, 4) AS INTEGER)"


def failing() -> list[str]:
    """Some directories, logs and DDL texts could not be read."""
    return [
        FILES.replace("AS size\n", "AS size, doc_id, CAST(substr(source, 4) AS INT) AS num\n"),
        DETAIL,
        "\nlisted AS (SELECT * FROM files WHERE NOT (num % 7 = 3 AND doc_id % 3 = 0))",
        PROFILE.replace("FROM files", "FROM listed"),
        BALANCE.replace("FROM files", "FROM listed"),
        BASED,
        balance("3e0"),
        HISTORY + f",\nrecent AS (SELECT * FROM hist WHERE {_NUM} % 5 <> 2)",
        PIVOT, LAST, status(), CADENCE, GROWTH,
        CLUSTERING.replace("FROM (SELECT DISTINCT", "FROM (SELECT * FROM (SELECT DISTINCT") + " WHERE k % 6 <> 4)",
        METRICS,
        """
unlisted AS (
  SELECT tbl, min('/lake/main/' || tbl || '/lang=' || part || '/b=0: PermissionError: denied') AS first_error, count(DISTINCT part) AS n
  FROM files WHERE num % 7 = 3 AND doc_id % 3 = 0 GROUP BY tbl),
erred AS (
  SELECT m.*, CASE WHEN n > 1 THEN first_error || ' (and ' || (n - 1) || ' more)' ELSE first_error END AS listing_error,
    CASE WHEN k % 5 = 2 THEN '/lake/main/' || tbl || '/_delta_log: FileNotFoundError: no such directory' END AS history_error,
    CASE WHEN k % 6 = 4 THEN 'command failed' END AS ddl_error
  FROM metrics m LEFT JOIN unlisted USING (tbl))""",
        *issue_ids(CERTAIN, "erred"),
    ]


def sparse() -> list[str]:
    """Little is known of most tables, by k % 4."""

    def either(listed: str, estimate: str, default: str) -> str:
        return f"CASE d.k % 4 WHEN 0 THEN {default} WHEN 1 THEN {estimate} ELSE p.{listed} END AS {listed}"

    avg = rnd("d.bytes / CAST(d.num_files AS DOUBLE) / 1048576e0")
    zeros = ("min_file_size_mb", "max_file_size_mb", "file_skew_ratio", "coefficient_of_variation")
    return [
        FILES,
        DETAIL.replace("detail AS (", "full_detail AS (").replace("sized AS (SELECT *", """
detail AS (
  SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN 0 ELSE num_files END AS num_files,
    CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 2 THEN 600::BIGINT * 1073741824 + bytes ELSE bytes END AS BIGINT) AS bytes,
    k % 4 = 1 AS partitioned) FROM full_detail),
sized AS (SELECT *"""),
        f"\nlisted AS (SELECT * FROM files WHERE {_NUM} % 4 <> 1)",
        PROFILE.replace("FROM files", "FROM listed").replace("prof AS (", "of_files AS ("),
        f"""
prof AS (
  SELECT d.tbl, {either("total_files", "d.num_files", "0")}, {either("avg_file_size_mb", avg, "0e0")},
    {either("median_file_size_mb", avg, "0e0")}, {", ".join(either(name, "0e0", "0e0") for name in zeros)},
    {either("small_files_pct", f"CASE WHEN {avg} < 128 THEN 100e0 ELSE 0e0 END", "0e0")},
    {either("severe_small_files_pct", f"CASE WHEN {avg} < 32 THEN 100e0 ELSE 0e0 END", "0e0")},
    {either("file_skew_severity", "'none'", "'none'")},
    CASE d.k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'detail' ELSE 'listing' END AS layout_source
  FROM detail d LEFT JOIN of_files p USING (tbl)),
pstat AS (
  SELECT tbl, CAST(count(DISTINCT part) AS INTEGER) AS n, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo, NULL::DOUBLE AS med, NULL::DOUBLE AS mean
  FROM files WHERE {_NUM} % 4 = 1 GROUP BY tbl)""",
        BASED,
        balance("3e0"),
        HISTORY + f",\nrecent AS (SELECT * FROM hist WHERE {_NUM} % 4 = 3)",
        PIVOT, LAST, status(), CADENCE, GROWTH,
        CLUSTERING.replace("FROM (SELECT DISTINCT", "FROM (SELECT * FROM (SELECT DISTINCT") + " WHERE k % 2 = 1)",
        METRICS,
        *issue_ids(RULES, "metrics"),
    ]


def assessed(as_of: str = AS_OF) -> list[str]:
    order = worst_first()
    summary = """'{"id":"' || issue_id || '","category":"' || category || '","severity":"' || severity || '","title":"' || title || '","details":"' || details || '"}'"""
    command = "'\"' || replace(sql_command, chr(10), '\\n') || '\"'"
    return [
        *metrics(as_of),
        f"\nfound AS ({rule_rows()})",
        f"""
ranked AS (SELECT *, {order} AS severity_order,
  CAST(row_number() OVER (PARTITION BY tbl ORDER BY {order}, rule_no) AS INTEGER) AS position FROM found)""",
        f"""
folded AS (
  SELECT tbl, CAST(count(*) AS INTEGER) AS issue_count, min(severity_order) AS worst,
    CAST(count(*) FILTER (severity = 'critical') AS INTEGER) AS critical_issues,
    CAST(count(*) FILTER (severity = 'high') AS INTEGER) AS high_issues,
    CAST(count(*) FILTER (severity = 'medium') AS INTEGER) AS medium_issues,
    CAST(count(*) FILTER (severity = 'low') AS INTEGER) AS low_issues,
    '[' || string_agg({summary}, ',' ORDER BY position) || ']' AS issues_summary,
    coalesce('[' || string_agg({command}, ',' ORDER BY position) FILTER (sql_command IS NOT NULL) || ']', '[]')
      AS sql_commands
  FROM ranked GROUP BY tbl)""",
        """
assessed AS (
  SELECT m.*, coalesce(f.issue_count, 0) AS issue_count, coalesce(f.critical_issues, 0) AS critical_issues,
    coalesce(f.high_issues, 0) AS high_issues, coalesce(f.medium_issues, 0) AS medium_issues,
    coalesce(f.low_issues, 0) AS low_issues, coalesce(f.issues_summary, '[]') AS issues_summary,
    coalesce(f.sql_commands, '[]') AS sql_commands,
    CASE f.worst WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END
      AS worst_severity,
    CASE WHEN NOT m.is_valid THEN 'error' WHEN f.worst = 0 THEN 'critical' WHEN f.worst = 1 THEN 'warning'
      WHEN f.worst = 2 THEN 'needs_attention' ELSE 'healthy' END AS health_status
  FROM metrics m LEFT JOIN folded f USING (tbl))""",
    ]


def _json(values: str) -> str:
    return f"CAST(to_json({values}) AS VARCHAR)"


def report(as_of: str = AS_OF, stamp: str = "2024-02-15T00:00:00") -> list[str]:
    def shown(value: str, name: str, blank: str) -> str:
        return f"CASE WHEN is_valid THEN {value} ELSE {blank} END AS {name}"

    listed = _json("CASE WHEN is_partitioned THEN ['lang'] ELSE CAST([] AS VARCHAR[]) END")
    return [
        *assessed(as_of),
        f"""
report AS (
  SELECT {KEYS},
    {shown("size_gb", "table_size_gb", "0e0")}, {shown("num_files", "num_files", "0")},
    {shown("avg_file_size_mb", "avg_file_size_mb", "0e0")},
    {shown("small_files_pct", "small_files_pct", "0e0")},
    {shown("severe_small_files_pct", "severe_small_files_pct", "0e0")},
    {shown("file_skew_ratio", "file_skew_ratio", "0e0")},
    {shown("file_skew_severity", "file_skew_severity", "'none'")},
    {shown("is_partitioned", "is_partitioned", "false")},
    {shown("partition_count", "partition_count", "0")},
    {shown(listed, "partition_columns", "'[]'")},
    {shown("partition_skew_ratio", "partition_skew_ratio", "0e0")},
    {shown("is_liquid_clustered", "is_liquid_clustered", "false")},
    {shown(_json("clustering_columns"), "clustering_columns", "'[]'")},
    {shown(_json("zorder_columns"), "zorder_columns", "'[]'")},
    {shown(iso("last_optimize"), "last_optimize", "NULL")},
    {shown("days_since_last_optimize", "last_optimize_days_ago", "NULL")},
    {shown("optimize_status", "optimize_status", "'Never'")},
    {shown(iso("last_vacuum"), "last_vacuum", "NULL")},
    {shown("days_since_last_vacuum", "last_vacuum_days_ago", "NULL")},
    {shown("vacuum_status", "vacuum_status", "'Never'")},
    health_status, issue_count, critical_issues, high_issues, medium_issues, low_issues,
    issues_summary, sql_commands, '{stamp}' AS analysis_timestamp, error
  FROM assessed)""",
    ]


HISTORY_COLUMNS = (
    'catalog, schema, "table", table_size_gb, num_files, avg_file_size_mb, small_files_pct, file_skew_severity, '
    "is_partitioned, is_liquid_clustered, optimize_status, vacuum_status, health_status, issue_count, analysis_timestamp"
)


def saved_reports(tail: str) -> str:
    runs = []
    for day in ("2024-02-01", "2024-02-08", "2024-02-15"):
        inner = query(report(f"TIMESTAMP '{day} 00:00:00'", f"{day}T00:00:00"), f"SELECT {HISTORY_COLUMNS} FROM report")
        runs.append(f"SELECT * FROM ({inner})")
    return f"SELECT * FROM ({' UNION ALL '.join(runs)}) {tail}"


def query(ctes: list[str], select: str) -> str:
    return f"WITH {','.join(ctes)}\n{select}"


def _simple(source: str, columns: str = "* EXCLUDE (tbl)") -> str:
    return f"SELECT {KEYS}, {columns} FROM {source}"


_BANDS = (
    "total_files, small_files_count, small_files_pct, severe_small_files_count, severe_small_files_pct, "
    "optimal_files_count, optimal_files_pct"
)
_LAYOUT = (
    "total_files, total_size_bytes, avg_file_size_bytes, avg_file_size_mb, median_file_size_mb, "
    "min_file_size_mb, max_file_size_mb, std_dev_mb"
)
_SKEW = "file_skew_ratio, has_file_skew, file_skew_severity, coefficient_of_variation, skew_description"
_COUNT_BASED = """
based AS (SELECT tbl, CAST(sum(size) AS BIGINT) AS bytes, true AS partitioned FROM files GROUP BY tbl)"""
_COUNTS = """
counts AS (SELECT tbl, count(DISTINCT part) AS n FROM files WHERE part IS NOT NULL GROUP BY tbl)"""
_value_bytes = "CAST(floor(value * 1000000) AS BIGINT)"
_age14 = f"({days(AS_OF, 'ts')} - 14)"

ORACLE: dict[str, str] = {
    "file_layout": query([FILES, PROFILE], _simple("prof", _LAYOUT)),
    "file_size_bands": query([FILES, PROFILE], _simple("prof", _BANDS)),
    "file_skew": query([FILES, PROFILE], _simple("prof", _SKEW)),
    "floor_percentile": query(
        [FILES],
        f"""SELECT {KEYS}, m AS percentile_mb, n AS total_files FROM (
  SELECT tbl, {mb("size")} AS m, count(*) OVER (PARTITION BY tbl) AS n,
    row_number() OVER (PARTITION BY tbl ORDER BY size) AS rn FROM files)
WHERE rn - 1 = least(floor(n * 95e0 / 100), n - 1)""",
    ),
    "layout_from_detail": query(
        [
            FILES,
            DETAIL,
            PROFILE,
            f"""
est AS (SELECT *, CAST(substr(tbl, 4) AS INTEGER) % 2 = 0 AS listed,
  {rnd('bytes / CAST(num_files AS DOUBLE) / 1048576e0')} AS avg_mb FROM detail)""",
        ],
        f"""SELECT {KEYS}, CASE WHEN listed THEN 'listing' ELSE 'detail' END AS layout_source,
  CASE WHEN listed THEN total_files ELSE num_files END AS total_files,
  CASE WHEN listed THEN avg_file_size_mb ELSE avg_mb END AS avg_file_size_mb,
  CASE WHEN listed THEN median_file_size_mb ELSE avg_mb END AS median_file_size_mb,
  CASE WHEN listed THEN max_file_size_mb ELSE 0e0 END AS max_file_size_mb,
  CASE WHEN listed THEN small_files_pct WHEN avg_mb < 128 THEN 100e0 ELSE 0e0 END AS small_files_pct,
  CASE WHEN listed THEN severe_small_files_pct WHEN avg_mb < 32 THEN 100e0 ELSE 0e0 END AS severe_small_files_pct,
  CASE WHEN listed THEN file_skew_severity ELSE 'none' END AS file_skew_severity
FROM est JOIN prof USING (tbl)""",
    ),
    "partition_sizes": query(
        [FILES],
        f"SELECT {KEYS}, part AS partition, CAST(sum(size) AS BIGINT) AS size_bytes FROM files WHERE part IS NOT NULL GROUP BY tbl, part",
    ),
    "partition_stats": query(
        [FILES, DETAIL, BALANCE, BASED, balance("3e0")],
        _simple("bal", "CASE WHEN is_partitioned THEN 'lang' ELSE '' END AS partition_columns, * EXCLUDE (tbl, ratio)"),
    ),
    "partition_count": query([PARTS, _COUNTS], _simple("counts", "n AS partition_count")),
    "partition_balance": query(
        [PARTS, _COUNT_BASED, BALANCE, balance("10e0")], _simple("bal", "* EXCLUDE (tbl, ratio)")
    ),
    "excess_partitions": query(
        [PARTS, _COUNTS],
        f"""SELECT {KEYS}, n AS partition_count,
  CASE WHEN n > 2700 THEN 'EXCESS_PARTITIONS' WHEN n > 2700 * 0.8e0 THEN 'HIGH_PARTITION_COUNT' END AS issue_id,
  CASE WHEN n > 2700 THEN 'critical' WHEN n > 2700 * 0.8e0 THEN 'medium' END AS severity,
  CASE WHEN n > 2700 * 0.8e0 THEN {counted("n")} || ' partitions' END AS current_value,
  CASE WHEN n > 2700 * 0.8e0 THEN 'at most 2,700 partitions' END AS threshold
FROM counts""",
    ),
    "partition_count_from_data": (
        "SELECT count(DISTINCT concat_ws('/', l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR))) "
        "AS partition_count FROM lineitem"
    ),
    "recent_history": query(
        [NEWEST],
        f"SELECT {KEYS}, version, {iso('ts')} AS timestamp, op AS operation FROM recent",
    ),
    "operation_counts": query(
        [RECENT], f"SELECT {KEYS}, op AS operation, count(*) AS commits FROM recent GROUP BY tbl, op"
    ),
    "operation_pivot": query([RECENT, PIVOT], _simple("pivot_ops")),
    "last_operations": query(
        [RECENT, LAST],
        _simple(
            "last_ops",
            ", ".join(
                f"{iso(c)} AS {c}"
                for c in (
                    "last_write", "last_optimize", "last_vacuum_end", "last_vacuum_start", "last_merge",
                    "last_delete", "last_update",
                )
            ),
        ),
    ),
    "maintenance_status": query(
        [RECENT, LAST, status()],
        _simple(
            "status",
            ", ".join(f"{iso('last_' + c)} AS last_{c}_timestamp" for c in ("write", "optimize", "vacuum", "merge"))
            + ", days_since_last_write, days_since_last_optimize, days_since_last_vacuum, optimize_status, vacuum_status",
        ),
    ),
    "zorder_columns": query(
        [RECENT, CADENCE],
        f"""SELECT {KEYS}, coalesce(array_to_string(zorder_columns, ','), '') AS zorder_columns,
  optimize_count AS zorder_usage_count, predicates AS predicate_optimizations
FROM cadence LEFT JOIN zcols USING (tbl)""",
    ),
    "optimize_cadence": query(
        [RECENT, CADENCE],
        _simple("cadence", f"optimize_count, {iso('last_ts')} AS last_optimize_timestamp, optimize_frequency_days"),
    ),
    "recent_optimizes": query(
        [RECENT],
        f"""SELECT {KEYS}, CAST(rn AS INTEGER) AS position, version, {iso("ts")} AS timestamp, zorder AS zorder_by
FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY ts DESC, version DESC) AS rn
  FROM recent WHERE op = 'OPTIMIZE') WHERE rn <= 5""",
    ),
    "growth": query([FILES, DETAIL, RECENT, GROWTH], _simple("grow")),
    "weekday_pattern": query(
        [FILES, DETAIL, RECENT, GROWTH],
        f"""SELECT {KEYS}, string_agg(weekday || '=' || n, ',' ORDER BY weekday || '=' || n) AS write_patterns,
  any_value(busiest_day) AS busiest_day
FROM weekdays JOIN busiest USING (tbl) GROUP BY tbl HAVING sum(n) >= 2""",
    ),
    "table_detail": query(
        [FILES, DETAIL],
        f"""SELECT {KEYS}, 'lake.main.' || tbl AS full_name, is_valid, error, format,
  '/lake/main/' || tbl AS location, bytes AS table_size_bytes, {mb("bytes")} AS table_size_mb,
  {gb("bytes")} AS table_size_gb, num_files, CASE WHEN partitioned THEN 'lang' ELSE '' END AS partition_columns,
  1 AS min_reader_version, 2 AS min_writer_version FROM detail""",
    ),
    "supported_tables": query([FILES, DETAIL], f"SELECT {KEYS} FROM detail WHERE format = 'delta'"),
    "clustering": query(
        [CLUSTERING], _simple("clus", "is_liquid_clustered, array_to_string(clustering_columns, ',') AS clustering_columns")
    ),
    "scalar_helpers": f"""SELECT event_id, {mb(_value_bytes)} AS size_mb, {gb(_value_bytes + " * 1000")} AS size_gb,
  {iso("ts")} AS iso, {_age14} AS age_days, {age(f"nullif({_age14}, 7)", "Never")} AS age_text,
  CASE WHEN user_id % 5 = 0 THEN -1e0 ELSE value / CAST(user_id % 5 AS DOUBLE) END AS quotient,
  {rnd("(user_id % 5) * 100e0 / 7")} AS pct, {tier("value / 4e0")} AS tier, dayname(ts) AS weekday,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE {_value_bytes} END AS digits, {grouped("value * 1000e0")} AS grouped,
  printf('%.1f', value) AS ratio, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE upper(event_type) END AS operation,
  'a|' || event_type AS names
FROM events""",
    "small_file_issues": query(
        [FILES, DETAIL, PROFILE, "\nmetrics AS (SELECT d.*, p.* EXCLUDE (tbl) FROM sized d JOIN prof p USING (tbl))",
         f"\nfound AS ({rule_rows(RULES[:2])})"],
        _simple("found", "issue_id, category, severity, current_value, sql_command"),
    ),
    "issues": query(
        assessed(),
        f"""SELECT {KEYS}, position, rule_no, issue_id, category, severity, title, details, current_value, threshold,
  recommendation, sql_command, '2024-02-15T00:00:00' AS analysis_timestamp FROM ranked""",
    ),
    "issue_counts": query(
        assessed(), _simple("assessed", "issue_count, critical_issues, high_issues, medium_issues, low_issues")
    ),
    "table_health": query(assessed(), _simple("assessed", "worst_severity, health_status")),
    "table_report": query(report(), "SELECT * FROM report"),
    "scope_single": query(report(), """SELECT * FROM report WHERE "table" = 'src19'"""),
    "scope_schema": query(report(), "SELECT * FROM report WHERE error IS NULL"),
    "scope_catalog": query(report(), "SELECT * FROM report WHERE error IS NULL"),
    "fleet_summary": query(
        assessed(),
        "SELECT count(*) AS tables, "
        + ", ".join(
            f"count(*) FILTER (health_status = '{s}') AS {s}"
            for s in ("healthy", "needs_attention", "warning", "critical", "error")
        )
        + " FROM assessed",
    ),
    "maintenance_sql": query(
        assessed(),
        f"""SELECT {KEYS}, 'lake.main.' || tbl AS full_name, health_status,
  CAST(row_number() OVER (PARTITION BY tbl ORDER BY position) AS INTEGER) AS step, sql_command AS statement
FROM ranked JOIN assessed USING (tbl) WHERE sql_command IS NOT NULL""",
    ),
    "source_failures": query(
        failing(),
        _simple(
            "erred LEFT JOIN raised USING (tbl)",
            "listing_error, history_error, ddl_error, total_files, history_available, is_liquid_clustered, "
            "coalesce(issue_ids, '') AS issue_ids",
        ),
    ),
    "table_defaults": query(
        sparse(),
        _simple(
            "metrics LEFT JOIN raised USING (tbl)",
            "layout_source, total_files, avg_file_size_mb, small_files_pct, partition_count, partition_sizes_estimated, "
            "largest_partition_size_mb, partition_skew_ratio, history_available, total_commits, optimize_status, "
            "is_liquid_clustered, coalesce(issue_ids, '') AS issue_ids",
        ),
    ),
    "extended_report": query(
        [
            *metrics(),
            f"""
operations AS (SELECT tbl, string_agg(op || '=' || n, ',' ORDER BY op) AS summary
  FROM (SELECT tbl, op, count(*) AS n FROM recent GROUP BY tbl, op) GROUP BY tbl),
newest AS (
  SELECT tbl, string_agg(version || '@' || {iso("ts")} || ' ' || zorder || ' ' || CASE WHEN event_id % 7 = 0 THEN '["a = 1"]' ELSE '' END, ';' ORDER BY rn) AS details
  FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY ts DESC, version DESC) AS rn FROM recent WHERE op = 'OPTIMIZE')
  WHERE rn <= 5 GROUP BY tbl)""",
        ],
        _simple(
            "metrics LEFT JOIN operations USING (tbl) LEFT JOIN newest USING (tbl)",
            "coalesce(summary, '') AS operation_summary, coalesce(details, '') AS optimize_details, total_commits, "
            "optimize_frequency_days, daily_write_count, partition_skew_severity",
        ),
    ),
    "walked_files": query(
        [FILES],
        f"SELECT DISTINCT {KEYS}, 'lang=' || part AS partition, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS named_files, true AS have_bytes FROM files",
    ),
    "logged_commits": query(
        [RECENT],
        f"""SELECT {KEYS}, count(*) AS commits, count(*) FILTER (op = 'OPTIMIZE') AS optimizes, max(version) AS newest_version,
  {iso("max(date_trunc('millisecond', ts))")} AS newest, 2 * count(*) FILTER (op = 'OPTIMIZE') AS parameters,
  count(*) FILTER (event_id % 10 NOT IN (0, 7)) AS sized_commits
FROM recent GROUP BY tbl""",
    ),
    "file_owners": """
WITH own AS (SELECT doc_id, lang, source, CAST(substr(source, 4) AS INT) AS k FROM documents),
named AS (SELECT *, '/lake/main/src' || (k - k % 2) AS outer_root, '/lake/main/src' || (k - k % 2) || '/nested/' || source AS inner_root FROM own),
paths AS (
  SELECT doc_id, CASE WHEN k = 19 THEN '/elsewhere' WHEN k % 2 = 0 OR doc_id % 5 = 0 THEN outer_root ELSE inner_root END
    || '/lang=' || lang || '/' || doc_id || '.parquet' AS path FROM named),
roots AS (SELECT DISTINCT source AS tbl, CASE WHEN k % 2 = 0 THEN outer_root ELSE inner_root END AS root FROM named)
SELECT 'lake' AS catalog, 'main' AS schema, tbl AS "table", doc_id, substr(path, length(root) + 2) AS relative_path
FROM paths JOIN roots ON starts_with(path, root || '/')
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(root) DESC) = 1""",
    "report_history": saved_reports(''),
    "latest_reports": saved_reports(
        'QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY analysis_timestamp DESC) = 1'
    ),
    "table_metrics": query(
        metrics(),
        _simple(
            "metrics",
            "is_valid, 'listing' AS layout_source, total_files, avg_file_size_mb, median_file_size_mb, std_dev_mb, "
            "small_files_count, optimal_files_count, file_skew_ratio, file_skew_severity, coefficient_of_variation, "
            "is_partitioned, partition_count, partition_skew_ratio, partition_skew_severity, is_liquid_clustered, "
            "history_available, total_commits, vacuum_count, days_since_last_optimize, days_since_last_vacuum, "
            "zorder_usage_count, optimize_frequency_days, daily_write_count, avg_write_size_mb, growth_rate_pct_daily, "
            "busiest_day",
        ),
    ),
}
