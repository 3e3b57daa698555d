"""Definition and change statements, carried out with DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut
from ..sources import files
from .dialect import StatementError, Token, closing, split_by, sql_type, text_of, type_end
from .division import expression_with_divisions
from .tables import Table


@dataclass(frozen=True)
class Conflict:
    """What an INSERT does with rows whose key is in the table: nothing, or changes."""

    keys: list[str]
    changes: dict[str, list[Token]]


class Reader:
    """Walks the tokens of a statement."""

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, *keys: str) -> bool:
        return [t.key for t in self.tokens[self.at : self.at + len(keys)]] == list(keys)

    def take(self, *keys: str) -> bool:
        found = self.peek(*keys)
        self.at += len(keys) if found else 0
        return found

    def need(self, *keys: str) -> None:
        if not self.take(*keys):
            raise StatementError(f"expected {' '.join(keys)} at {text_of(self.rest()[:4]) or 'the end'!r}")

    def rest(self) -> list[Token]:
        return self.tokens[self.at :]

    def name(self) -> str:
        """A name of one or more parts."""
        parts = []
        while True:
            if self.at >= len(self.tokens) or self.tokens[self.at].kind not in ("word", "name"):
                raise StatementError("expected a name")
            parts.append(self.tokens[self.at].text)
            self.at += 1
            if not self.take("."):
                return ".".join(parts)

    def brackets(self) -> list[Token]:
        end = closing(self.tokens, self.at)
        inner = self.tokens[self.at + 1 : end]
        self.at = end + 1
        return inner

    def end(self) -> None:
        if self.rest():
            raise StatementError(f"unexpected {text_of(self.rest()[:4])!r}")


class Statements:
    """Carries statements out on a session's tables; each gives a DataFrame."""

    def __init__(self, session) -> None:
        self.session, self.tables, self.spark = session, session.tables, session.spark

    def run(self, tokens: list[Token]) -> DataFrame | None:
        """The result of a statement that isn't a query; None for a query."""
        kinds = {"CREATE": self.create, "DROP": self.drop, "INSERT": self.insert, "DELETE": self.delete, "UPDATE": self.update, "COPY": self.copy, "SHOW": self.show}
        if not tokens or tokens[0].key not in kinds:
            return None
        reader = Reader(tokens)
        reader.at = 1
        return kinds[tokens[0].key](reader)

    def done(self, count: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(count,)], "row long")

    def query(self, tokens: list[Token]) -> DataFrame:
        """A SELECT, or the short form ``FROM name`` of one."""
        if tokens and tokens[0].key == "FROM":
            return self.tables.get(Reader(tokens[1:]).name()).frame
        return self.session.query(tokens)

    def show(self, r: Reader) -> DataFrame:
        r.need("TABLES")
        r.end()
        return self.tables.listing()

    def create(self, r: Reader) -> DataFrame:
        if r.take("SCHEMA"):
            lenient = r.take("IF", "NOT", "EXISTS")
            key = self.tables.key(r.name() + ".x")[:2]
            if key in self.tables.schemas and not lenient:
                raise StatementError(f"there is a schema {key[1]!r}")
            self.tables.schemas.add(key)
            return self.done()
        r.need("TABLE")
        lenient = r.take("IF", "NOT", "EXISTS")
        name = r.name()
        if lenient and self.tables.key(name) in self.tables.tables:
            return self.done()
        if r.take("AS"):
            self.tables.put(name, Table(cut(self.query(r.rest()))))
            return self.done()
        fields, required = [], set()
        if not r.peek("("):
            raise StatementError("expected columns or AS")
        parts = split_by(r.brackets())
        r.end()
        for part in parts if parts[-1] else parts[:-1]:  # a comma may come last
            column, end = part[0].text.strip("`").lower(), type_end(part, 1)
            keys = [t.key for t in part[end:]]
            strict = "PRIMARY" in keys or any(a == "NOT" and b == "NULL" for a, b in zip(keys, keys[1:], strict=False))
            if strict:
                required.add(column)
            if set(keys) - {"PRIMARY", "KEY", "UNIQUE", "NOT", "NULL"}:
                raise StatementError(f"unexpected {text_of(part[end:])!r}")
            fields.append(f"`{column}` {sql_type(part[1:end])}")
        schema = T._parse_datatype_string(", ".join(fields))
        if len({f.name for f in schema.fields}) < len(schema.fields):
            raise StatementError("two columns have the same name")
        self.tables.put(name, Table(self.spark.createDataFrame([], schema), required=frozenset(required)))
        return self.done()

    def drop(self, r: Reader) -> DataFrame:
        schema = r.take("SCHEMA")
        if not schema:
            r.need("TABLE")
        lenient = r.take("IF", "EXISTS")
        name = r.name()
        r.end()
        if schema:
            key = self.tables.key(name + ".x")[:2]
            if key not in self.tables.schemas and not lenient:
                raise StatementError(f"no schema {name!r}")
            if any(k[:2] == key for k in self.tables.tables):
                raise StatementError(f"schema {name!r} has tables")
            self.tables.schemas.discard(key)
        elif not lenient or self.tables.key(name) in self.tables.tables:
            self.tables.drop(name)
        return self.done()

    def append(self, name: str, rows: DataFrame, columns: list[str] | None, conflict: Conflict | None = None) -> DataFrame:
        """Cast rows to a table's columns by position and add them; others get their default or null."""
        table = self.tables.get(name)
        targets = [table.field_of(c) for c in columns] if columns else table.frame.schema.fields
        if len({f.name for f in targets}) < len(targets):
            raise StatementError("a column is named twice")
        if len(targets) != len(rows.columns):
            raise StatementError(f"{len(rows.columns)} values for {len(targets)} columns")
        given = dict(zip([f.name for f in targets], rows.toDF(*(f"c{i}" for i in range(len(targets)))).columns, strict=True))
        rows = rows.toDF(*given.values())
        out: list[Column] = []
        for f in table.frame.schema.fields:
            value = F.col(given[f.name]) if f.name in given else F.lit(table.defaults.get(f.name))
            if f.name not in given and f.name in table.required and f.name not in table.defaults:
                raise StatementError(f"column {f.name!r} needs a value")
            out.append(value.cast(f.dataType).alias(f.name))
        added = cut(rows.select(*out))
        for c in sorted(table.required):
            if not added.where(F.col(c).isNull()).isEmpty():
                raise StatementError(f"column {c!r} can't be null")
        if conflict is not None:
            return self.upsert(name, added, conflict)
        self.tables.replace(name, table.frame.unionByName(added))
        return added

    def upsert(self, name: str, added: DataFrame, conflict: Conflict) -> DataFrame:
        """Add the rows whose keys aren't in the table, and change those that are; the rows added or changed."""
        table = self.tables.get(name)
        keys = [table.field_of(c).name for c in conflict.keys] or sorted(table.required)
        if not keys:
            raise StatementError("ON CONFLICT needs columns")
        same = lambda old, new: reduce(and_, (F.col(f"{old}.{k}") == F.col(f"{new}.{k}") for k in keys))
        repeated = added.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        if conflict.changes:
            if not repeated.isEmpty():
                raise StatementError("two rows of one INSERT have the same key")
            new = added
        else:  # of rows with one key the first stays
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.monotonically_increasing_id()))
            whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
            new = cut(added.withColumn("__nth", F.when(whole, nth).otherwise(1)).where("__nth = 1").drop("__nth"))
        fresh = cut(new.alias("new").join(table.frame.alias("old"), same("old", "new"), "left_anti"))
        frame = table.frame
        done = fresh
        if conflict.changes:
            last = name.rsplit(".", 1)[-1].strip("`").lower()
            pairs = frame.alias(last).join(new.alias("excluded"), same(last, "excluded"), "left")
            hit = F.col(f"excluded.{keys[0]}").isNotNull()
            changed = {table.field_of(c).name: F.expr(text_of(self.session.rewritten(x))) for c, x in conflict.changes.items()}
            columns = [F.when(hit, changed[f.name].cast(f.dataType)).otherwise(F.col(f"{last}.{f.name}")).alias(f.name) if f.name in changed else F.col(f"{last}.{f.name}") for f in frame.schema.fields]
            flagged = cut(pairs.select(*columns, hit.alias("__hit")))
            frame = flagged.drop("__hit")
            done = fresh.unionByName(flagged.where("__hit").drop("__hit"))
        self.tables.replace(name, frame.unionByName(fresh))
        return done

    def conflict(self, tokens: list[Token]) -> Conflict:
        """``ON CONFLICT [(columns)] DO NOTHING`` or ``DO UPDATE SET column = value, …``, where ``excluded`` is the new row."""
        r = Reader(tokens)
        r.need("ON", "CONFLICT")
        keys = [t.text.strip("`") for part in split_by(r.brackets()) for t in part] if r.peek("(") else []
        r.need("DO")
        if r.take("NOTHING"):
            r.end()
            return Conflict(keys, {})
        r.need("UPDATE", "SET")
        parts = split_by(r.rest())
        if any(len(p) < 3 or p[1].text != "=" for p in parts):
            raise StatementError("expected column = value")
        return Conflict(keys, {p[0].text.strip("`"): p[2:] for p in parts})

    def insert(self, r: Reader) -> DataFrame:
        r.need("INTO")
        name = r.name()
        if r.take("AS"):
            r.name()
        elif r.rest() and r.rest()[0].kind in ("word", "name") and r.rest()[0].key not in ("VALUES", "SELECT", "FROM", "WITH", "DEFAULT"):
            r.name()
        columns = [t.text.strip("`") for part in split_by(r.brackets()) for t in part] if r.peek("(") else None
        body, listed, conflict = r.rest(), None, None
        outer = [i for i in range(len(body)) if sum((t.text == "(") - (t.text == ")") for t in body[:i]) == 0]
        if at := [i for i in outer if body[i].key == "RETURNING"]:
            body, listed = body[: at[0]], body[at[0] + 1 :]
        if at := [i for i in outer if i + 1 < len(body) and (body[i].key, body[i + 1].key) == ("ON", "CONFLICT")]:
            conflict = self.conflict(body[at[0] :])
            body = body[: at[0]]
        done = self.append(name, self.source_of(Reader(body)), columns, conflict)
        if listed is None:
            return self.done(done.count())
        last = name.rsplit(".", 1)[-1].strip("`").lower()
        view = f"__returned_{next(self.session.views)}"
        done.createOrReplaceTempView(view)
        return self.session.query_text(f"SELECT {text_of(listed)} FROM {view} AS `{last}`")

    def source_of(self, r: Reader) -> DataFrame:
        """The rows that an INSERT adds: VALUES as one inline table, or a query."""
        if not r.take("VALUES"):
            return self.query(r.rest())
        rows = []
        while True:
            if not r.peek("("):
                raise StatementError("expected a row of values")
            rows.append(split_by(r.brackets()))
            if not r.take(","):
                break
        r.end()
        if len({len(x) for x in rows}) > 1:
            raise StatementError("rows have different widths")
        names = ", ".join(f"c{i}" for i in range(len(rows[0])))
        listed = ", ".join(f"({', '.join(text_of(v) for v in x)})" for x in rows)
        return self.session.query_text(f"SELECT * FROM VALUES {listed} AS v({names})")

    def expression(self, tokens: list[Token], name: str) -> Column:
        """An expression over a table's columns."""
        text = text_of(self.session.rewritten(tokens))
        return F.expr(expression_with_divisions(self.spark, text, self.tables.view(self.tables.key(name))))

    def condition(self, r: Reader, name: str) -> Column:
        """Whether a WHERE clause holds; unknown counts as no."""
        if not r.rest():
            return F.lit(True)
        r.need("WHERE")
        return F.coalesce(self.expression(r.rest(), name), F.lit(False))

    def delete(self, r: Reader) -> DataFrame:
        r.need("FROM")
        name = r.name()
        frame = self.tables.get(name).frame
        gone = self.condition(r, name)
        count = frame.where(gone).count()
        self.tables.replace(name, frame.where(~gone))
        return self.done(count)

    def update(self, r: Reader) -> DataFrame:
        name = r.name()
        r.need("SET")
        rest = r.rest()
        where = next((i for i, t in enumerate(rest) if t.key == "WHERE" and sum((x.text == "(") - (x.text == ")") for x in rest[:i]) == 0), len(rest))
        table = self.tables.get(name)
        new = {}
        for part in split_by(rest[:where]):
            if len(part) < 3 or part[1].text != "=":
                raise StatementError("expected column = value")
            new[table.field_of(part[0].text.strip("`")).name] = self.expression(part[2:], name)
        r.at += where
        change = self.condition(r, name)
        count = table.frame.where(change).count()
        columns = [F.when(change, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in table.frame.schema.fields]
        frame = table.frame.select(*columns)
        for c in sorted(table.required & new.keys()):
            if not frame.where(F.col(c).isNull()).isEmpty():
                raise StatementError(f"column {c!r} can't be null")
        self.tables.replace(name, frame)
        return self.done(count)

    def copy(self, r: Reader) -> DataFrame:
        source = None
        columns = None
        if r.peek("("):
            source = self.query(r.brackets())
        else:
            name = r.name()
            columns = [t.text.strip("`") for part in split_by(r.brackets()) for t in part] if r.peek("(") else None
        into = r.take("FROM")
        if not into:
            r.need("TO")
        if not r.rest() or r.rest()[0].kind != "string":
            raise StatementError("expected a path")
        path = r.rest()[0].text[1:-1].replace("''", "'")
        r.at += 1
        options: dict[str, str] = {}
        if r.peek("("):
            for part in split_by(r.brackets()):
                options[part[0].key] = part[1].text.strip("'") if len(part) > 1 else "true"
        r.end()
        if set(options) - {"FORMAT", "HEADER", "DELIMITER"}:
            raise StatementError(f"unknown options {sorted(options)}")
        form = options.get("FORMAT", "csv").lower()
        header, delimiter = options.get("HEADER", "false").lower() == "true", options.get("DELIMITER", ",")
        if not into:
            frame = source if source is not None else self.tables.get(name).frame
            count = frame.count()
            files.write(frame.select(*columns) if columns else frame, path, form, header, delimiter)
            return self.done(count)
        if source is not None or form not in ("csv", "tbl"):
            raise StatementError("COPY reads csv and tbl files into a table")
        table = self.tables.get(name)
        targets = [table.field_of(c) for c in columns] if columns else table.frame.schema.fields
        schema = ", ".join(f"c{i} string" for i in range(len(targets)))
        return self.done(self.append(name, files.read_csv(self.spark, path, header, delimiter, schema=schema), columns).count())
