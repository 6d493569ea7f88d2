"""Names, statement text, and the small texts found in metadata."""

from ..schemas import KEY

NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"

_BLANKS = r"' \t\n\r\f\u000b'"

# DDL grammar: what is no name or keyword, a name (back-quoted parts keep anything), and
# the clause with one name or a list of them.
_BACK_QUOTED = r"`(?:[^`]|``)*`"
_NO_CODE = rf"({_BACK_QUOTED})|(?s:/[*].*?[*]/)|--[^\n]*|'(?:[^'\\]|\\.)*'"
_A_NAME = rf'(?:{_BACK_QUOTED}|"[^"]*"|[^\s,()`"])+'
_CLUSTER_CLAUSE = rf"(?iU)\bCLUSTER\s+BY\s*([(](?:{_BACK_QUOTED}|[^`()])*[)]|(?<=\s){_A_NAME}|{_BACK_QUOTED})"
# Spark's own DDL text states clustering as a table property holding name paths.
_CLUSTER_PROPERTY = r"'clusteringColumns'\s*=\s*'([^']*)'"


def sql_string(value: str) -> str:
    """A text as a SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _strip(text: str, characters: str = _BLANKS) -> str:
    return f"btrim({text}, {characters})"


def full_name() -> str:
    return f"concat_ws('.', {', '.join(f'`{k}`' for k in KEY)})"


def _quote(name: str) -> str:
    return f"concat('`', replace({name}, '`', '``'), '`')"


def quoted_name(suffix: str = "") -> str:
    """Back-quoted dotted identifier of the row's table, or of one with a suffixed name."""
    *above, table = (f"`{k}`" for k in KEY)
    parts = [*above, f"concat({table}, '{suffix}')" if suffix else table]
    return f"concat_ws('.', {', '.join(map(_quote, parts))})"


def quoted_list(names: str) -> str:
    return f"array_join(transform({names}, c -> {_quote('c')}), ', ')"


def file_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def partition_of_path(path: str) -> str:
    """The ``k=v/k2=v2`` part of a file path, of any depth; null without one."""
    return f"nullif(array_join(regexp_extract_all({path}, '([^/=]+=[^/]*)/', 1), '/'), '')"


def operation_name(operation: str) -> str:
    """Upper-cased operation; a missing or empty one is UNKNOWN."""
    return f"upper(coalesce(nullif({operation}, ''), 'UNKNOWN'))"


def _raw(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return '"' + pattern.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _clause(ddl: str) -> str:
    """What the first CLUSTER BY names, outside of comments and literals; empty without one."""
    code = f"regexp_replace({ddl}, {_raw(_NO_CODE)}, '$1 ')"
    return f"regexp_extract({code}, {_raw(_CLUSTER_CLAUSE)}, 1)"


def _property(ddl: str) -> str:
    return f'regexp_extract({ddl}, r"{_CLUSTER_PROPERTY}", 1)'


def has_cluster_by(ddl: str) -> str:
    return f"coalesce({_clause(ddl)} <> '' OR {_property(ddl)} <> '', false)"


def clustering_columns(ddl: str) -> str:
    """Columns named by the first CLUSTER BY clause, else by the table property."""
    clause = _clause(ddl)
    names = f"regexp_extract_all({clause}, {_raw(_A_NAME)}, 0)"
    bare = r"""replace(regexp_replace(replace(c, '``', '\u0001'), '[`"]', ''), '\u0001', '`')"""
    listed = f"transform({names}, c -> {bare})"
    paths = f"from_json({_property(ddl)}, 'array<array<string>>')"
    named = f"transform({paths}, p -> array_join(p, '.'))"
    return f"CASE WHEN {clause} <> '' THEN {listed} ELSE coalesce({named}, {NO_STRINGS}) END"


def parse_zorder(text: str) -> str:
    """Columns in a z-order parameter: a JSON array, or a comma-separated list.

    Text that opens like an array but is not valid JSON is read as a list with
    its brackets and quotes removed. Only that form drops blank entries.
    """
    parsed = f"CASE WHEN endswith(rtrim({text}), ']') THEN from_json({text}, 'array<string>') END"
    bare = f"""regexp_replace({text}, r'[\\[\\]"]', '')"""
    salvaged = f"filter(transform(split({bare}, ','), c -> {_strip('c')}), c -> c <> '')"
    unquoted = _strip(_strip("c"), r"""'"\''""")
    listed = f"transform(split({text}, ','), c -> {unquoted})"
    return (
        f"CASE WHEN {text} IS NULL OR {text} = '' THEN {NO_STRINGS} "
        f"WHEN startswith({text}, '[') THEN coalesce(array_compact({parsed}), {salvaged}) "
        f"ELSE {listed} END"
    )


def number_text(value: str, digits: int = 2) -> str:
    """Grouped fixed-point text; plain casts turn 1e7 into 1.0E7."""
    return f"format_number({value}, {digits})"


def ratio_text(value: str) -> str:
    """One decimal, half-even on the binary value."""
    return f"format_number(CAST({value} AS DOUBLE), '0.0')"
