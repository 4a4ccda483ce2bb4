"""Versions of table schemas: a registry, migrations applied in order and recorded, and drift as the difference of two schema trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from proofmill.sources.delivery import exists
from proofmill.tables import read_table

#: The input tables by version, newest last: what the library reads, and what it read before.
VERSIONS: dict[str, tuple[str, ...]] = {
    "documents": ("doc_id int, text string, lang string", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "labels": ("doc_id bigint, quality int, toxic boolean, note string", "doc_id bigint, quality int, toxic int"),
    "embeddings": ("vec_id bigint, embedding array<double>, label int", "vec_id bigint, embedding array<float>, label int"),
    "conversations": ("conv_id bigint, turn bigint, role string, text string",),
    "benchmark": ("item_id bigint, text string",),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",),
    "pages": ("page_id bigint, html string", "page_id bigint, url string, html string"),
}
MIGRATION_NAME = re.compile(r"^(\d{3})_([a-z0-9_]+)$")
APPLIED = "version int, name string, applied_at timestamp"


class MigrationFailed(RuntimeError):
    """A migration with a wrong name, a number used twice, or one that does not give the schema it promises."""


@dataclass(frozen=True)
class Migration:
    """A step ``name`` (``NNN_lower_case``) that changes the frames of some tables; ``becomes`` are the schemas that it promises, as DDL."""

    name: str
    change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    becomes: dict[str, str]

    @property
    def version(self) -> int:
        return int(MIGRATION_NAME.match(self.name).group(1))


def ordered(migrations: list[Migration]) -> list[Migration]:
    """Migrations by number; a name that does not parse or a number used twice is an error, not a skip."""
    bad = [m.name for m in migrations if not MIGRATION_NAME.match(m.name)]
    if bad:
        raise MigrationFailed(f"not a migration's name: {', '.join(sorted(bad))}")
    numbers = [m.version for m in migrations]
    twice = sorted({n for n in numbers if numbers.count(n) > 1})
    if twice:
        raise MigrationFailed(f"numbers used twice: {twice}")
    return sorted(migrations, key=lambda m: m.version)


def applied_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the migrations recorded below ``path``, in order."""
    if not exists(spark, f"{path}/schema_version"):
        return []
    return [r["version"] for r in spark.read.schema(APPLIED).parquet(f"{path}/schema_version").select("version").distinct().orderBy("version").collect()]


def migrate(spark: SparkSession, path: str, migrations: list[Migration]) -> list[int]:
    """Apply every migration not yet recorded to the tables below ``path``, in order; returns the numbers applied.

    A step writes each table it changes to a folder of its own number, checks it against the schema it promises, and is recorded last: a
    step that was cut off runs again, one that was recorded never does. ``latest`` reads the newest folder of a table.
    """
    have, newly = applied_versions(spark, path), []
    for step in ordered(migrations):
        if step.version in have:
            continue
        before = {name: latest(spark, path, name, have) for name in step.becomes if exists(spark, f"{path}/{name}")}
        for name, frame in step.change(before).items():
            drifted = differences(StructType.fromDDL(step.becomes[name]), frame.schema)
            if drifted:
                raise MigrationFailed(f"{step.name}: {name}.{drifted[0][0]} is {drifted[0][3]}, not {drifted[0][2]}")
            frame.write.mode("overwrite").parquet(f"{path}/{name}/v{step.version:03d}")
        row = spark.createDataFrame([(step.version, step.name)], "version int, name string").withColumn("applied_at", F.current_timestamp())
        row.write.mode("append").parquet(f"{path}/schema_version")
        have.append(step.version)
        newly.append(step.version)
    return newly


def latest(spark: SparkSession, path: str, name: str, versions: list[int] | None = None) -> DataFrame:
    """The table ``name`` as the newest recorded migration left it."""
    known = applied_versions(spark, path) if versions is None else versions
    for version in sorted(known, reverse=True):
        if exists(spark, f"{path}/{name}/v{version:03d}"):
            return spark.read.parquet(f"{path}/{name}/v{version:03d}")
    raise MigrationFailed(f"{name} is of no recorded version")


# -- drift


def tree(kind: DataType, at: str = "") -> dict[str, str]:
    """Type of each node of a schema by its path: fields after a dot, elements of an array as ``[]``, keys and values of a map in braces."""
    if isinstance(kind, StructType):
        own = {at: "struct"} if at else {}
        for field in kind.fields:
            own |= tree(field.dataType, f"{at}.{field.name}" if at else field.name)
        return own
    if isinstance(kind, ArrayType):
        return {at: "array"} | tree(kind.elementType, f"{at}[]")
    if isinstance(kind, MapType):
        return {at: "map"} | tree(kind.keyType, f"{at}{{key}}") | tree(kind.valueType, f"{at}{{value}}")
    return {at: kind.simpleString()}


def differences(expected: StructType, actual: StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(path, change, expected, actual) of each node that is missing, unexpected or of another type; order and nullability are no drift."""
    want, have = tree(expected), tree(actual)
    change = lambda p: "missing" if p not in have else "unexpected" if p not in want else "type"
    return [(p, change(p), want.get(p), have.get(p)) for p in sorted({*want, *have}) if want.get(p) != have.get(p)]


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the given tables differ from each registered version of their schema; only their footers are read."""
    rows = [
        (table, number, *found) for table, versions in VERSIONS.items() for number, ddl in enumerate(versions, 1) for found in differences(StructType.fromDDL(ddl), read_table(spark, sf_dir, table).schema)
    ]
    return spark.createDataFrame(rows, "table string, version int, path string, change string, expected string, actual string")


def _sql() -> str:
    """DuckDB names the types of its views in words of its own."""
    words = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    names = "CASE replace(data_type, '[]', '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items()) + " END"
    flat = [(table, number, *node) for table, versions in VERSIONS.items() for number, ddl in enumerate(versions, 1) for node in _flat(ddl)]
    values = ", ".join(f"('{table}', {number}, '{path}', '{kind}')" for table, number, path, kind in flat)
    return f"""WITH w(tbl, version, path, kind) AS (VALUES {values}), n AS (SELECT DISTINCT tbl, version FROM w),
        c AS (SELECT table_name AS tbl, column_name, data_type, data_type LIKE '%[]' AS listed, {names} AS kind FROM information_schema.columns),
        h AS (SELECT tbl, column_name AS path, CASE WHEN listed THEN 'array' ELSE kind END AS kind FROM c UNION ALL SELECT tbl, column_name || '[]', kind FROM c WHERE listed),
        v AS (SELECT n.tbl, n.version, h.path, h.kind FROM n JOIN h USING (tbl))
        SELECT coalesce(w.tbl, v.tbl) AS "table", coalesce(w.version, v.version) AS version, coalesce(w.path, v.path) AS path, CASE WHEN v.path IS NULL THEN 'missing' WHEN w.path IS NULL THEN 'unexpected' ELSE 'type' END AS change,
            w.kind AS expected, v.kind AS actual FROM w FULL JOIN v ON w.tbl = v.tbl AND w.version = v.version AND w.path = v.path WHERE w.kind IS DISTINCT FROM v.kind"""


def _flat(ddl: str) -> list[tuple[str, str]]:
    """Nodes of a flat schema with arrays of plain types, without a session."""
    out = []
    for field in ddl.split(", "):
        name, kind = field.split(" ", 1)
        inner = re.match(r"array<(\w+)>$", kind)
        out += [(name, "array"), (f"{name}[]", inner.group(1))] if inner else [(name, kind)]
    return out


QUERIES = {"schema_drift": (schema_drift, _sql())}
