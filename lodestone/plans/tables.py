"""The tables of a session: a namespace of DataFrames that statements replace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.lineage import cut
from .dialect import StatementError

#: Changes after which a table's lineage is cut, so that plans stay short.
MOST_CHANGES = 8


@dataclass
class Table:
    frame: DataFrame
    kind: str = "BASE TABLE"
    defaults: dict[str, object] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    changes: int = 0

    def field_of(self, name: str) -> T.StructField:
        for f in self.frame.schema.fields:
            if f.name.lower() == name.lower():
                return f
        raise StatementError(f"no column {name!r}")


class Tables:
    """Tables by catalog, schema and name, each also a temporary view that Spark SQL sees."""

    def __init__(self, spark: SparkSession, catalog: str = "lodestone", schema: str = "public") -> None:
        self.spark, self.catalog, self.schema = spark, catalog, schema
        self.schemas = {(catalog, schema)}
        self.tables: dict[tuple[str, str, str], Table] = {}

    def key(self, name: str) -> tuple[str, str, str]:
        """Catalog, schema and table of a name of one to three parts, in lower case."""
        parts = [p.strip("`").lower() for p in name.split(".")]
        if not 1 <= len(parts) <= 3:
            raise StatementError(f"a table name has one to three parts: {name}")
        return (*(self.catalog, self.schema)[: 3 - len(parts)], *parts)

    def view(self, key: tuple[str, str, str]) -> str:
        """The temporary view's name: the bare name in the default schema."""
        catalog, schema, name = key
        return name if (catalog, schema) == (self.catalog, self.schema) else f"{catalog}__{schema}__{name}"

    def get(self, name: str) -> Table:
        table = self.tables.get(self.key(name))
        if table is None:
            raise StatementError(f"no table {name!r}")
        return table

    def put(self, name: str, table: Table) -> None:
        key = self.key(name)
        if key[:2] not in self.schemas:
            raise StatementError(f"no schema {'.'.join(key[:2])!r}")
        self.tables[key] = table
        table.frame.createOrReplaceTempView(self.view(key))

    def replace(self, name: str, frame: DataFrame) -> None:
        """Put a changed table's rows in place of the old ones."""
        table = self.get(name)
        table.changes += 1
        table.frame = cut(frame) if table.changes % MOST_CHANGES == 0 else frame
        table.frame.createOrReplaceTempView(self.view(self.key(name)))

    def drop(self, name: str) -> None:
        key = self.key(name)
        if self.tables.pop(key, None) is None:
            raise StatementError(f"no table {name!r}")
        self.spark.catalog.dropTempView(self.view(key))

    def listing(self) -> DataFrame:
        """``information_schema.tables``."""
        rows = [(*k[:2], k[2], t.kind) for k, t in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "catalog_name string, schema_name string, table_name string, table_type string")
