"""A session: SQL in the engine's dialect over Spark SQL, and the tables it owns."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.udf import register_aggregate, register_scalar, register_table_function
from .plans import dialect
from .plans.dialect import StatementError, Token
from .plans.division import with_divisions
from .plans.statements import Statements
from .plans.tables import Table, Tables
from .sources import files

STATEMENTS = ("CREATE", "DROP", "INSERT", "DELETE", "UPDATE", "COPY", "SHOW")


class Session:
    """Queries and statements over tables that live as long as the session.

    Planning, optimization and execution are Spark's. The session changes no Spark
    setting, so its results don't depend on null order, ordinal or type settings.
    """

    def __init__(self, spark: SparkSession, catalog: str = "lodestone", schema: str = "public") -> None:
        self.spark = spark
        self.tables = Tables(spark, catalog, schema)
        self.statements = Statements(self)
        self.views = itertools.count()

    def sql(self, text: str) -> DataFrame:
        """Run one statement. Queries stay lazy; other statements are carried out at once."""
        tokens = dialect.tokens_of(text)
        if not tokens:
            raise StatementError("an empty statement")
        done = self.statements.run(tokens)
        return self.query(tokens) if done is None else done

    def query(self, tokens: list[Token]) -> DataFrame:
        return self.query_text(dialect.text_of(tokens))

    def query_text(self, text: str) -> DataFrame:
        tokens = dialect.tokens_of(text)
        if tokens[0].key not in ("SELECT", "WITH", "VALUES", "("):
            raise StatementError(f"not a statement: {tokens[0].text}")
        text = dialect.text_of(self.rewritten(tokens))
        return self.spark.sql(with_divisions(self.spark, text))

    def rewritten(self, tokens: list[Token]) -> list[Token]:
        """Tokens as Spark SQL reads them, with table names resolved."""
        return self.named(dialect.with_functions(dialect.normalized(tokens), files.READERS, self.file_view))

    def named(self, tokens: list[Token]) -> list[Token]:
        """Names of two or three parts that are tables, as the names of their views.

        In FROM a view keeps the table's own name as its alias, so that columns can be
        qualified by the name's last part; if two tables of one FROM share it, both go by
        the views' names.
        """
        found: list[tuple[int, int, int, str, str]] = []  # from, to, scope, view, last part
        sources: dict[tuple[int, str], set[str]] = {}
        scopes, scope, i = dialect.scopes_of(tokens), 0, 0
        places = dialect.source_places(tokens)
        while i < len(tokens):
            end = i + 1
            while end + 1 < len(tokens) and tokens[end].text == "." and tokens[i].kind in ("word", "name") and tokens[end + 1].kind in ("word", "name"):
                end += 2
            parts = [t.text.strip("`").lower() for t in tokens[i:end:2]]
            for n in range(min(3, len(parts)), 1, -1):
                view = self.view_named(parts[:n])
                if view is not None:
                    scope = scopes[i]
                    found.append((i, i + 2 * n - 1, scope, view, parts[n - 1]))
                    if i in places:
                        sources.setdefault((scope, parts[n - 1]), set()).add(view)
                    break
            i = end
        out, at = [], 0
        for start, stop, scope, view, last in found:
            out += tokens[at:start]
            at = stop
            inner = next((s for s in dialect.enclosing(scopes, tokens, start) if view in sources.get((s, last), ())), scope)
            alias = last if len(sources.get((inner, last), ())) == 1 else view
            if start in places:
                out += dialect.words(view) if dialect.has_alias(tokens, stop) or alias == view else dialect.words(f"{view} AS `{alias}`")
            else:
                out += dialect.words(f"`{alias}`")
        return out + tokens[at:]

    def view_named(self, parts: list[str]) -> str | None:
        if parts[-2:] == ["information_schema", "tables"]:
            self.tables.listing().createOrReplaceTempView("information_schema__tables")
            return "information_schema__tables"
        key = self.tables.key(".".join(parts))
        return self.tables.view(key) if key in self.tables.tables else None

    def file_view(self, function: str, arguments: list[list[Token]]) -> str:
        """A view of a file, for a table function in FROM."""
        if not arguments[0] or arguments[0][0].kind != "string" or len(arguments[0]) > 1:
            raise StatementError(f"{function} needs a path")
        path = arguments[0][0].text[1:-1].replace("''", "'")
        options: dict = {}
        names = {"delim": "delimiter", "delimiter": "delimiter", "sep": "delimiter", "quote": "quote", "escape": "escape", "header": "header", "columns": "schema"}
        for part in arguments[1:]:
            name = names.get(part[0].text.lower()) if function == "read_csv" else None
            if name == "schema" and len(part) > 3 and part[1].text in ("=", "=>") and part[2].text == "{":
                options[name] = dialect.columns_of(part[2:])
                continue
            if name in (None, "schema") or len(part) != 3 or part[1].text not in ("=", "=>"):
                raise StatementError(f"{function} doesn't know {dialect.text_of(part)!r}")
            options[name] = part[2].key == "TRUE" if name == "header" else part[2].text[1:-1]
        view = f"__file_{next(self.views)}"
        getattr(files, function)(self.spark, path, **options).createOrReplaceTempView(view)
        return view

    def register_table(self, name: str, frame: DataFrame, defaults: dict[str, object] | None = None, required: tuple[str, ...] = ()) -> None:
        """Make a DataFrame a table, with values for columns that an INSERT leaves out."""
        self.tables.put(name, Table(frame, "LOCAL TEMPORARY", dict(defaults or {}), frozenset(required)))

    def register_catalog(self, catalog: str, *schemas: str) -> None:
        """Make a catalog's schemas (``public`` if none is named) places for tables."""
        self.tables.schemas |= {(catalog.lower(), s.lower()) for s in schemas or ("public",)}

    def register_udf(self, name: str, function: Callable, returns: str) -> Callable:
        """Register a function over Arrow arrays under any case of its name."""
        return register_scalar(self.spark, name, function, returns)

    def register_udaf(self, name: str, function: Callable, returns: str) -> Callable:
        """Register an aggregate over the Arrow arrays of a group."""
        return register_aggregate(self.spark, name, function, returns)

    def register_udtf(self, name: str, handler: type, returns: str) -> None:
        """Register a table function: a class whose ``eval`` yields rows."""
        register_table_function(self.spark, name, handler, returns)

    def table(self, name: str) -> DataFrame:
        return self.tables.get(name).frame

    def show_tables(self) -> DataFrame:
        return self.tables.listing()
