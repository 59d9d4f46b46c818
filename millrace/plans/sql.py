"""Guarded SQL, named KPI statements and tenant scoping."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import authorize
from millrace.plans.authorize import Rule

# What a guarded statement may begin with and what it may not contain.
READ_PREFIXES = ("SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN")
FORBIDDEN = (
    "DROP ", "DELETE ", "TRUNCATE ", "INSERT ", "UPDATE ", "ALTER ", "CREATE TABLE", "GRANT ", "REVOKE ",
)
#: Functions that run code of the caller's choice, and formats that turn a path into a table.
CODE_FUNCTIONS = ("java_method", "reflect", "try_reflect")
FILE_FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "xml", "delta", "jdbc", "image", "libsvm")

_NOISE = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)


_LITERALS = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.DOTALL)


class RejectedSql(ValueError):
    pass


def check_sql(sql: str) -> str:
    """Raise unless the text is a read-only statement. Literals and comments do not count; quoted names do."""
    bare = re.sub(r"\s+", " ", _NOISE.sub(" ", sql)).strip().upper()
    named = _LITERALS.sub(" ", sql).replace("`", "").lower()
    if re.search(rf"\b({'|'.join(CODE_FUNCTIONS)})\s*\(", named):
        raise RejectedSql("functions that run code are not allowed")
    if re.search(rf"\b({'|'.join(FILE_FORMATS)})\s*\.\s*(/|\.|\w+:)", named):
        raise RejectedSql("files are no tables")
    if not re.match(rf"({'|'.join(READ_PREFIXES)})\b", bare):
        raise RejectedSql(f"a statement must begin with one of {', '.join(READ_PREFIXES)}")
    padded = f"{bare} "
    for phrase in FORBIDDEN:
        if re.search(rf"(?<![A-Z0-9_]){re.escape(phrase)}", padded):
            raise RejectedSql(f"{phrase.strip()} is not allowed")
    return bare


def _checked(spark: SparkSession, sql: str, args: Mapping[str, object] | None, tables: Rule | None = None) -> tuple[str, DataFrame]:
    """The statement's table, once its text and its parsed plan have passed: no command, whatever word it begins with,
    no code, and tables of the catalog only, which ``tables`` allows by name."""
    bare = check_sql(sql)
    used = authorize.uses(spark, sql)
    if bare.startswith(("SELECT", "WITH")) and used.commands:
        raise RejectedSql("the statement is a command")
    if used.scripts:
        raise RejectedSql("scripts and names put together at run time are not allowed")
    if code := sorted({f.rsplit(".", 1)[-1] for f in used.functions} & set(CODE_FUNCTIONS)):
        raise RejectedSql(f"functions that run code are not allowed: {', '.join(code)}")
    if odd := sorted(used.table_functions - authorize.TABLE_FUNCTIONS):
        raise RejectedSql(f"table functions that are not allowed: {', '.join(odd)}")
    if tables is not None and bare.startswith("SHOW"):
        raise RejectedSql("lists of tables are not allowed under a rule for tables")
    for name in used.tables:
        if tables is not None and not tables(".".join(name).lower()):
            raise RejectedSql(f"table {'.'.join(name)!r} is not allowed")
        if not authorize.is_table(spark, name):
            raise RejectedSql(f"{'.'.join(name)!r} is no table; files are none")
    return bare, spark.sql(sql, args=dict(args) if args else None)


def guarded_sql(
    spark: SparkSession, sql: str, limit: int | None = None, args: Mapping[str, object] | None = None, tables: Rule | None = None
) -> DataFrame:
    """Run a read-only statement: all its rows, or ``limit`` of them; ``is_truncated`` tells if there are more.

    ``tables`` is asked for every table that the statement reads anywhere, by its name in lower case:
    ``tenant_rule``, ``authorize.names`` or any function of a name."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    bare, df = _checked(spark, sql, args, tables)
    return df.limit(limit) if limit is not None and bare.startswith(("SELECT", "WITH")) else df


def is_truncated(
    spark: SparkSession, sql: str, limit: int | None = None, args: Mapping[str, object] | None = None, tables: Rule | None = None
) -> bool:
    """Whether the statement has more than ``limit`` rows; at most one more than that is read."""
    return limit is not None and _checked(spark, sql, args, tables)[1].limit(limit + 1).count() > limit


def run_kpis(
    spark: SparkSession, kpis: Iterable[Mapping[str, object]], limit: int | None = None, tables: Rule | None = None
) -> dict[str, DataFrame]:
    """Named statements, in order, each with all its rows unless a limit is asked for. A KPI without SQL is an error."""
    out: dict[str, DataFrame] = {}
    for kpi in kpis:
        if not kpi.get("sql"):
            raise ValueError(f"KPI {kpi.get('name')!r} has no sql")
        out[str(kpi.get("name") or f"kpi_{len(out) + 1}")] = guarded_sql(spark, str(kpi["sql"]), limit, kpi.get("args"), tables)
    return out


def kpi_summary(kpis: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """name, columns and row count of each KPI, and whether a fetch of ``limit`` rows would cut it."""
    cut = F.lit(False) if limit is None else F.col("row_count") > limit
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "row_count", cut.alias("truncated")
        )
        for name, df in kpis.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_allowed(name: Column, tenant: str, mode: str = "prefix", separator: str = "_", pattern: str | None = None) -> Column:
    """Whether a tenant may use a table of that name."""
    if mode == "prefix":
        return name.startswith(tenant + separator)
    if mode == "schema":
        return name.startswith(tenant + ".")
    if mode == "custom":
        if not pattern:
            raise ValueError("custom mode needs a pattern")
        return name.rlike(pattern)
    if mode == "metadata":
        return F.lit(False)
    raise ValueError(f"unknown mode {mode!r}")


def tenant_rule(tenant: str, mode: str = "prefix", separator: str = "_", pattern: str | None = None) -> Rule:
    """``table_allowed`` as a rule for single names, for ``guarded_sql``; upper and lower case are equal, as in the catalog."""
    own = tenant.lower()
    rules: dict[str, Rule] = {
        "prefix": lambda name: name.lower().startswith(own + separator.lower()),
        "schema": lambda name: name.lower().startswith(own + "."),
        "custom": lambda name: bool(pattern and re.search(pattern, name, re.IGNORECASE)),
        "metadata": lambda name: False,
    }
    if mode not in rules:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "custom" and not pattern:
        raise ValueError("custom mode needs a pattern")
    return rules[mode]


def require_table(name: str, tenant: str, mode: str = "prefix", separator: str = "_", pattern: str | None = None) -> None:
    """Strict form of ``table_allowed`` for a single name."""
    allowed = {
        "prefix": lambda: name.startswith(tenant + separator),
        "schema": lambda: name.startswith(tenant + "."),
        "custom": lambda: bool(pattern and re.search(pattern, name)),
        "metadata": lambda: False,
    }
    if not allowed[mode]():
        raise PermissionError(f"tenant {tenant!r} may not use {name!r}")


def tenant_scope(df: DataFrame, tenant: object, column: str = "tenant_id") -> DataFrame:
    """Only the rows of one tenant; the predicate reaches the scan."""
    return df.where(F.col(column) == F.lit(tenant))
