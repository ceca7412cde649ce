"""Databases behind JDBC: tables, keys and row estimates from their system tables; only Spark connects."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from minnow.catalog import Catalog, ForeignKey
from minnow.errors import SourceError

# How a URL names a database, what that database calls its default schema, and where it keeps row estimates.
DEFAULT_SCHEMA = {"postgresql": "public", "mysql": "", "mariadb": "", "sqlserver": "dbo"}
ESTIMATES = {
    "postgresql": "SELECT n.nspname AS s, c.relname AS t, CAST(c.reltuples AS bigint) AS n FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p') AND c.reltuples >= 0",
    "mysql": "SELECT table_schema AS s, table_name AS t, table_rows AS n FROM information_schema.tables WHERE table_rows IS NOT NULL",
    "mariadb": "SELECT table_schema AS s, table_name AS t, table_rows AS n FROM information_schema.tables WHERE table_rows IS NOT NULL",
    "sqlserver": "SELECT SCHEMA_NAME(o.schema_id) AS s, o.name AS t, SUM(p.rows) AS n FROM sys.objects o JOIN sys.partitions p ON p.object_id = o.object_id AND p.index_id IN (0, 1) WHERE o.type = 'U' GROUP BY o.schema_id, o.name",
}
TABLES = "SELECT table_schema AS s, table_name AS t FROM information_schema.tables WHERE table_type = 'BASE TABLE'"
KEYS = """
SELECT c.constraint_name AS name, c.constraint_type AS kind, k.table_schema AS s, k.table_name AS t, k.column_name AS col, k.ordinal_position AS place,
  u.table_schema AS target_s, u.table_name AS target_t, u.column_name AS target_col
FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name
LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = c.constraint_schema AND r.constraint_name = c.constraint_name
LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.ordinal_position{more}
WHERE c.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')
"""
#: Where a primary key's constraint is called PRIMARY in every table, the referenced table must be told too.
MORE = {"mysql": " AND u.table_name = r.referenced_table_name", "mariadb": " AND u.table_name = r.referenced_table_name"}


def dialect_of(url: str) -> str:
    name = url.removeprefix("jdbc:").partition(":")[0]
    if not url.startswith("jdbc:") or name not in DEFAULT_SCHEMA:
        raise SourceError("the URL begins with jdbc: and a known database", tuple(DEFAULT_SCHEMA))
    return name


def keys_of(rows: Iterable[dict], name: Callable[[str, str], str]) -> tuple[dict[str, tuple[str, ...]], list[ForeignKey]]:
    """Primary and foreign keys from rows of KEYS, columns in the order of the key."""
    found: defaultdict[tuple[str, str, str], list[dict]] = defaultdict(list)
    for r in rows:
        found[r["kind"], name(r["s"], r["t"]), r["name"]].append(r)
    primary, foreign = {}, []
    for (kind, table, _), parts in sorted(found.items()):
        parts.sort(key=lambda r: r["place"])
        columns = tuple(r["col"] for r in parts)
        if kind == "PRIMARY KEY":
            primary[table] = columns
        elif all(r["target_t"] for r in parts):
            foreign.append(ForeignKey(table, columns, name(parts[0]["target_s"], parts[0]["target_t"]), tuple(r["target_col"] for r in parts)))
    return primary, foreign


def catalog(spark: SparkSession, url: str, schemas: tuple[str, ...] = (), **options: str) -> Catalog:
    """A catalog of the tables of some schemas (the default one without any) with their keys and estimates, by three statements."""
    dialect = dialect_of(url)
    read = spark.read.format("jdbc").options(url=url, **options)
    rows = lambda text: [r.asDict() for r in read.option("query", text).load().collect()]
    default = DEFAULT_SCHEMA[dialect] or url.partition("?")[0].rpartition("/")[2]
    wanted = schemas or (default,)
    name = lambda s, t: t if s == default else f"{s}.{t}"
    listed = [(r["s"], r["t"]) for r in rows(TABLES) if r["s"] in wanted]
    primary, foreign = keys_of([r for r in rows(KEYS.format(more=MORE.get(dialect, ""))) if r["s"] in wanted], name)
    estimates = {name(r["s"], r["t"]): int(r["n"]) for r in rows(ESTIMATES[dialect]) if r["s"] in wanted}

    def frame(schema: str, table: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{table}", **options).load()

    return Catalog({name(s, t): frame(s, t) for s, t in listed}, primary, foreign, row_estimates=estimates)
