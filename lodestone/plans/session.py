"""A session: tables, variables, temporary tables, cursors, and the interpreter of scripts.

Queries become one Spark SQL text each. Temporary tables are versions of Parquet folders in the shared
checkpoint folder, each with a hidden row identifier; a statement that changes one writes the next
version and swaps the view, so lineage stays short and no rows pass through the driver."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..sources import bulk
from .ast import Query, Select, Statement, Table
from .emit import HIDDEN, Emitter, Scope, ident, literal
from .errors import TSqlError, translate, unsupported
from .parser import parse
from .types import base, of_spark, spark_type

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Result:
    frames: list[DataFrame] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    rowcounts: list[int] = field(default_factory=list)

    @property
    def frame(self) -> DataFrame:
        return self.frames[-1]


class _Stop(Exception):
    pass


class Session:
    """spark: the session; tables: DataFrames by name. Options: case_insensitive (text comparison and
    LIKE ignore case), block_update_without_where, block_delete_without_where, now (the clock), and
    filters.Context fields for users and fiscal calendars. Callbacks: on_message, on_statement, before_dml."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, *, now: dt.datetime | None = None, case_insensitive: bool = False, block_update_without_where: bool = False, block_delete_without_where: bool = False, **context):
        self.spark = spark
        self.prefix = f"ls_{uuid.uuid4().hex[:10]}"
        self.case_insensitive = case_insensitive
        self.block = {"update": block_update_without_where, "delete": block_delete_without_where}
        self.filters = filters.Context(**({"now": now} if now else {}), **context)
        self.frames: dict[str, DataFrame] = {}
        self.views: dict[str, tuple[str, dict]] = {}
        self.temp: dict[str, dict] = {}
        self.parents: dict[str, tuple[str, str, str]] = {}
        self.variables: dict[str, list] = {}
        self.cursors: dict[str, dict] = {}
        self.messages: dict[str, Callable] = {}
        self.state = {"@@rowcount": 0, "@@error": 0, "@@fetch_status": 0, "@@identity": None, "@@servername": "spark", "@@version": "Lodestone T-SQL on Spark"}
        self.error: TSqlError | None = None
        self.on_message = self.on_statement = self.before_dml = lambda *a: None
        for name, frame in (tables or {}).items():
            self.register(name, frame)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, names: list[str] = TABLES, **options) -> Session:
        """A session over the Parquet tables of a folder; a table is opened when it is first named."""
        session = cls(spark, **options)
        session.folder, session.folder_names = sf_dir, set(names)
        return session

    folder: str | None = None
    folder_names: set = set()

    def register(self, name: str, frame: DataFrame) -> None:
        view = f"{self.prefix}_{re.sub(r'[^A-Za-z0-9_]', '_', name)}"
        frame.createOrReplaceTempView(view)
        self.frames[name.lower()] = frame
        self.views[name.lower()] = (view, {f.name: of_spark(f.dataType) for f in frame.schema})

    def register_hierarchy(self, table: str, key: str, parent: str) -> None:
        self.parents[key.lower()] = (table, key, parent)

    def register_message(self, name: str, make: Callable[..., DataFrame]) -> None:
        """make(*args) gives the rows of ``SELECT * FROM name(args)`` and of ``EXEC name args``."""
        self.messages[name.lower()] = make

    # -- what the emitter asks for
    def table(self, parts: list[str]) -> tuple[str, dict]:
        name = parts[-1].lower()
        if len(parts) > 1 and parts[-2].lower() == "metadata":
            from ..sources.catalog import metadata

            key = f"metadata.{name}"
            if key not in self.views:
                self.register(key, metadata(self, name))
            return self.views[key]
        if len(parts) > 1 and parts[-2].lower() == "sys" and name == "messages":
            from ..sources.catalog import messages

            self.register("sys.messages", messages(self.spark))
            return self.views["sys.messages"]
        if name not in self.views and name in self.folder_names:
            self.register(name, self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        if name not in self.views and not name.startswith("#"):
            full = ".".join(ident(p) for p in parts if p)
            if self.spark.catalog.tableExists(".".join(p for p in parts if p)):
                return full, {f.name: of_spark(f.dataType) for f in self.spark.table(full).schema}
        if name not in self.views:
            raise TSqlError(f"Invalid object name '{'.'.join(parts)}'.", 208)
        return self.views[name]

    def variable(self, name: str) -> tuple[str | None, object]:
        low = name.lower()
        if low.startswith("@@"):
            if low not in self.state:
                raise TSqlError(f"Must declare the scalar variable \"{name}\".", 137)
            value = self.state[low]
            return ("string" if isinstance(value, str) else "int"), value
        if low not in self.variables:
            raise TSqlError(f"Must declare the scalar variable \"{name}\".", 137)
        return tuple(self.variables[low])

    def error_info(self, what: str):
        return None if self.error is None else {"number": self.error.number, "message": self.error.message, "severity": self.error.severity, "state": self.error.state, "line": self.error.line}.get(what)

    def bulk(self, path: str, options: dict, schema: list) -> tuple[str, dict]:
        frame = bulk.read(self.spark, path, options, schema)
        name = f"bulk_{uuid.uuid4().hex[:8]}"
        self.register(name, frame)
        view, columns = self.views[name]
        return view, {c: k for c, k in columns.items() if c not in ("_path", "_name", "_parts")} | {c: columns[c] for c in ("_path", "_name", "_parts") if False}

    def message(self, name: str, args: list):
        make = self.messages.get(name.lower())
        if make is None:
            return None
        key = f"message_{uuid.uuid4().hex[:8]}"
        self.register(key, make(*args))
        return self.views[key]

    def hierarchy(self, op: str, column: str, key: str, value, alias: str | None) -> str:
        """under, eqorunder, notunder, above, eqorabove: members of a parent-child table, by recursion."""
        if key.lower() not in self.parents:
            raise TSqlError(f"No hierarchy is registered for column '{key}'.", 40517)
        table, key, parent = self.parents[key.lower()]
        view, columns = self.table([table])
        start = literal(value, columns.get(key))
        a, b = (key, parent) if op not in ("above", "eqorabove") else (parent, key)
        # downwards: children of members; upwards: parents of members. A member is met once a level.
        anchor = f"SELECT {ident(key)} AS k FROM {view} WHERE {ident(key)} = {start}" if op in ("eqorunder", "eqorabove") else (
            f"SELECT {ident(key)} AS k FROM {view} WHERE {ident(parent)} = {start} AND {ident(key)} <> {start}" if a == key else f"SELECT {ident(parent)} AS k FROM {view} WHERE {ident(key)} = {start} AND {ident(parent)} IS NOT NULL AND {ident(parent)} <> {start}"
        )
        step = f"SELECT t.{ident(a)} FROM {view} t JOIN h ON t.{ident(b)} = h.k WHERE t.{ident(key)} <> t.{ident(parent)}"
        if op in ("above", "eqorabove"):
            step += f" AND t.{ident(parent)} IS NOT NULL"
        # the path keeps a member from being met again below itself, so that cycles end
        anchor = f"SELECT k, array(k) AS p FROM ({anchor})"
        step = step.replace(f"SELECT t.{ident(a)} FROM", f"SELECT t.{ident(a)}, concat(h.p, array(t.{ident(a)})) FROM") + f" AND NOT array_contains(h.p, t.{ident(a)})"
        rows = self.spark.sql(f"WITH RECURSIVE h(k, p) MAX RECURSION LEVEL 1000 AS ({anchor} UNION ALL {step}) SELECT DISTINCT k FROM h")
        name = f"{self.prefix}_h{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(name)
        return f"({column} {'NOT ' if op == 'notunder' else ''}IN (SELECT k FROM {name}))" if op != "notunder" else f"({column} NOT IN (SELECT k FROM {name}) AND {column} <> {start})"

    # -- entry points
    def sql(self, text: str, params: dict | None = None) -> Result:
        """Run a script. params: values of @name parameters."""
        for name, value in (params or {}).items():
            self.variables["@" + name.lstrip("@").lower()] = [_kind(value), value]
        result = Result()
        Run(self, parse(text), result).go()
        return result

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        """The last result of a script as a DataFrame."""
        found = self.sql(text, params)
        if not found.frames:
            raise TSqlError("The script returns no rows.", 0)
        return found.frame

    def explain(self, text: str) -> str:
        """Spark's formatted plan of the script's last query."""
        frame = self.query(text)
        return self.spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")

    def translate(self, text: str) -> str:
        """The Spark SQL of a single query."""
        (statement,) = parse(text)
        return Emitter(self).query(statement.query)[0]

    def frame_of(self, query: Query) -> tuple[DataFrame, list]:
        sql, columns = Emitter(self).query(query, None, True)
        return self.spark.sql(sql), columns

    # -- temporary tables
    def _folder(self) -> str:
        found = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
        if not found and not self.spark.sparkContext.master.startswith("local"):
            raise TSqlError("Temporary tables need a folder that all executors share: set spark.checkpoint.dir.", 40517)
        return f"{(found or tempfile.gettempdir()).rstrip('/')}/lodestone-temp/{self.prefix}"

    def write_temp(self, name: str, frame: DataFrame) -> int:
        """The next version of a temporary table; rows without an identifier get one."""
        info = self.temp[name.lower()]
        path = f"{self._folder()}/{uuid.uuid4().hex}"
        if HIDDEN not in frame.columns:
            frame = frame.withColumn(HIDDEN, F.monotonically_increasing_id())
        frame.write.parquet(path)
        stored = self.spark.read.schema(frame.schema).parquet(path)
        info["paths"] = [path]
        self.register(name, stored)
        info["next"] = (stored.agg(F.max(HIDDEN)).first()[0] or 0) + 1
        return info["next"]


    def append_temp(self, name: str, new: DataFrame) -> int:
        """Add rows to a temporary table: one more folder of files. Returns how many there are."""
        info = self.temp[name.lower()]
        path = f"{self._folder()}/{uuid.uuid4().hex}"
        new.write.parquet(path)
        n, last = self.spark.read.schema(new.schema).parquet(path).agg(F.count("*"), F.max(HIDDEN)).first()
        info["paths"].append(path)
        info["next"] = max(info["next"], (last or 0) + 1)
        self.register(name, self.spark.read.schema(new.schema).parquet(*info["paths"]))
        return n


def _kind(value) -> str | None:
    return {bool: "bit", int: "int" if isinstance(value, int) and abs(value) < 2**31 else "bigint", float: "float", str: "string", bytes: "binary", dt.date: "date", dt.datetime: "datetime2"}.get(type(value), "string" if value is not None else "null")


class Run:
    """Runs a list of statements: they are laid out as one list of steps with jumps, so that GOTO, loops
    and handlers share one program counter. Statements are bound when they are reached."""

    def __init__(self, session: Session, statements: list[Statement], result: Result):
        self.s, self.result = session, result
        self.steps: list[tuple] = []
        self.labels: dict[str, int] = {}
        self.layout(statements, None)
        for step in self.steps:
            if step[0] == "goto" and step[1] not in self.labels:
                raise TSqlError(f"A GOTO statement references the label '{step[1]}' but the label has not been declared.", 133)

    def layout(self, statements: list[Statement], loop: tuple | None) -> None:
        for st in statements:
            if st.kind == "block":
                self.layout(st.body, loop)
            elif st.kind == "label":
                if st.name.lower() in self.labels:
                    raise TSqlError(f"The label '{st.name}' has already been declared.", 132)
                self.labels[st.name.lower()] = len(self.steps)
            elif st.kind == "if":
                at = self.add("unless", st.test, None)
                self.layout([st.body], loop)
                if st.other is not None:
                    end = self.add("jump", None)
                    self.steps[at] = ("unless", st.test, len(self.steps))
                    self.layout([st.other], loop)
                    self.steps[end] = ("jump", len(self.steps))
                else:
                    self.steps[at] = ("unless", st.test, len(self.steps))
            elif st.kind == "while":
                at = self.add("unless", st.test, None)
                exits: list[int] = []
                self.layout([st.body], (at, exits))
                self.add("jump", at)
                self.steps[at] = ("unless", st.test, len(self.steps))
                for x in exits:
                    self.steps[x] = ("jump", len(self.steps))
            elif st.kind in ("break", "continue"):
                if loop is None:
                    raise TSqlError(f"Cannot use a {st.kind.upper()} statement outside the scope of a WHILE statement.", 135)
                if st.kind == "break":
                    loop[1].append(self.add("jump", None))
                else:
                    self.add("jump", loop[0])
            elif st.kind == "goto":
                self.add("goto", st.name.lower())
            elif st.kind == "try":
                at = self.add("try", None)
                self.layout(st.body, loop)
                self.add("end_try")
                end = self.add("jump", None)
                self.steps[at] = ("try", len(self.steps))
                self.layout(st.handler, loop)
                self.add("end_catch")
                self.steps[end] = ("jump", len(self.steps))
            else:
                self.add("do", st)

    def add(self, *step) -> int:
        self.steps.append(step)
        return len(self.steps) - 1

    def go(self) -> None:
        at, handlers, spark = 0, [], self.s.spark
        while at < len(self.steps):
            kind, *rest = self.steps[at]
            at += 1
            try:
                if kind == "jump":
                    at = rest[0]
                elif kind == "goto":
                    at = self.labels[rest[0]]
                elif kind == "unless":
                    sql = Emitter(self.s).cond(rest[0], Scope())
                    if not spark.sql(f"SELECT coalesce({sql}, false)").first()[0]:
                        at = rest[1]
                elif kind == "try":
                    handlers.append(rest[0])
                elif kind == "end_try":
                    handlers.pop()
                elif kind == "end_catch":
                    self.s.error = None
                else:
                    # inside a handler's reach a query must run now, so that its errors are caught
                    getattr(self, f"do_{rest[0].kind}")(rest[0], bool(handlers))
                    self.s.state["@@error"] = 0
                    self.s.on_statement(rest[0].kind)
            except _Stop:
                return
            except Exception as error:
                found = translate(error)
                self.s.state["@@error"] = found.number
                if not handlers:
                    raise found from error
                self.s.error, at = found, handlers.pop()

    # -- statements
    def do_select(self, st: Statement, eager: bool) -> None:
        body = st.query.body
        if isinstance(body, Select) and any(i[2] for i in body.items):
            if not all(i[2] for i in body.items):
                raise TSqlError("A SELECT statement that assigns a value to a variable must not be combined with data-retrieval operations.", 141)
            return self.assign(st.query)
        frame, columns = self.s.frame_of(st.query)
        if eager:
            from ..plans.spill import keep

            frame = keep(self.s, frame)
        self.result.frames.append(frame)

    def assign(self, query: Query) -> None:
        """SELECT @v = ...: each row in turn; without a loop over itself the last row wins."""
        body = query.body
        own = {i[2].lower() for i in body.items}
        frame, _ = self.s.frame_of(query)
        if not body.source:
            rows = [frame.first()]
        elif any(_uses(i[0], own) or i[3] != "=" for i in body.items):
            return self.accumulate(query, own)
        else:
            rows = frame.tail(1)
        self.s.state["@@rowcount"] = len(rows)
        for row in rows:
            for (_, _, name, op), value in zip(body.items, row):
                self.put(name, op, value)

    def accumulate(self, query: Query, own: set) -> None:
        """SELECT @v = @v + x, or @v += x: rows come one after another and add to the variables."""
        items = query.body.items
        added = []
        for i, (x, alias, name, op) in enumerate(items):
            if op == "=" and isinstance(x, tuple) and x[:2] == ("bin", "+") and x[2][0] == "var" and x[2][1].lower() == name.lower():
                x, op = x[3], "+="
            if op not in ("=", "+=") or _uses(x, own):
                raise unsupported("An assignment over rows other than the sum of a variable and an expression")
            added.append((name, op))
            items[i] = (x, alias or f"a{i}", None, "=")
        frame, _ = self.s.frame_of(query)
        total = {name: self.s.variable(name)[1] for name, _ in added}
        n = 0
        for row in frame.toLocalIterator():
            n += 1
            for (name, op), value in zip(added, row):
                old = total[name]
                text = isinstance(old, str) or isinstance(value, str)
                total[name] = value if op == "=" else None if old is None or value is None else f"{old}{value}" if text else old + value
        self.s.state["@@rowcount"] = n
        for name, value in total.items():
            if n:
                self.put(name, "=", value)

    def put(self, name: str, op: str, value) -> None:
        kind, old = self.s.variable(name)
        text = literal(value, _kind(value))
        if op != "=":
            x = ("bin", op[0], ("var", name), ("raw", text, _kind(value)))
            emitter = Emitter(self.s)
            emitter.x_raw = lambda n, scope: (n[1], n[2])
            text = emitter.expr(x, Scope())[0]
        size = re.search(r"\((\d+)\)", kind or "")
        sql = f"CAST({text} AS {spark_type(kind)})" if kind not in (None, "null") else text
        if base(kind) == "string" and not (kind or "").endswith("(max)") and (size or kind.split("(")[0] in ("varchar", "nvarchar", "char", "nchar")):
            sql = f"left({sql}, {size[1] if size else 1})"
        self.s.variables[name.lower()][1] = self.s.spark.sql(f"SELECT {sql}").first()[0]

    def do_declare(self, st, eager) -> None:
        for name, kind, value in st.items:
            if name.lower() in self.s.variables:
                raise TSqlError(f"The variable name '{name}' has already been declared.", 134)
            spark_type(kind)
            self.s.variables[name.lower()] = [kind, None]
            if value is not None:
                self.put(name, "=", self.value(value))

    def value(self, x):
        return self.s.spark.sql(f"SELECT {Emitter(self.s).expr(x, Scope())[0]}").first()[0]

    def do_set(self, st, eager) -> None:
        self.put(st.name, st.op, self.value(st.value))

    def do_option(self, st, eager) -> None:
        self.s.state[st.name.lower()] = st.value

    def do_print(self, st, eager) -> None:
        self.say("" if (v := self.value(st.value)) is None else str(v))

    def say(self, text: str) -> None:
        self.result.messages.append(text)
        self.s.on_message(text)

    def do_return(self, st, eager) -> None:
        raise _Stop

    def do_throw(self, st, eager) -> None:
        if not st.args["args"]:
            if self.s.error is None:
                raise TSqlError("To rethrow an error, a THROW statement must be used inside a CATCH block.", 10704)
            raise self.s.error
        number, message, state = (self.value(a) for a in st.args["args"])
        raise TSqlError(str(message), int(number), 16, int(state), st.line)

    def do_raiserror(self, st, eager) -> None:
        message, severity, state, *rest = (self.value(a) for a in st.args["args"])
        text = re.sub(r"%[iu]", "%d", str(message)) % tuple(rest) if rest else str(message)
        if severity > 10:
            raise TSqlError(text, 50000, int(severity), int(state), st.line)
        self.say(text)

    def do_waitfor(self, st, eager) -> None:
        h, m, s = (str(self.value(st.value)) + ":0").split(":")[:3]
        seconds = int(h) * 3600 + int(m) * 60 + float(s)
        if st.mode == "TIME":
            now = dt.datetime.now()
            seconds = (seconds - (now.hour * 3600 + now.minute * 60 + now.second)) % 86400
        time.sleep(seconds)

    def do_exec(self, st, eager) -> None:
        if st.name.lower() == "sp_executesql":
            args = st.args["args"]
            text = str(self.value(args[0][1]))
            saved = dict(self.s.variables)
            declared = re.findall(r"(@\w+)\s+((?:\w+)(?:\([^)]*\))?)(\s+OUT(?:PUT)?)?", str(self.value(args[1][1])), re.I) if len(args) > 1 else []
            inner: dict[str, list] = {}
            outs = []
            for i, (name, kind, out) in enumerate(declared):
                own = args[2 + i] if 2 + i < len(args) and args[2 + i][0] is None else next((a for a in args[2:] if a[0] and a[0].lower() == name.lower()), None)
                inner[name.lower()] = [kind, self.value(own[1]) if own else None]
                if out and own and own[2]:
                    outs.append((name.lower(), own[1][1]))
            self.s.variables = inner
            try:
                Run(self.s, parse(text), self.result).go()
                got = {target: self.s.variables[name][1] for name, target in outs}
            finally:
                self.s.variables = saved
            for target, value in got.items():
                self.put(target, "=", value)
            return
        made = self.s.message(st.name, [self.value(a[1]) for a in st.args["args"]])
        if made is None:
            raise TSqlError(f"Could not find stored procedure '{st.name}'.", 2812)
        self.result.frames.append(self.s.spark.table(made[0]))

    # -- cursors: rows come to the driver as they are fetched
    def do_declare_cursor(self, st, eager) -> None:
        if st.name.lower() in self.s.cursors:
            raise TSqlError(f"A cursor with the name '{st.name}' already exists.", 16915)
        self.s.cursors[st.name.lower()] = {"query": st.query, "open": False}

    def cursor(self, name: str, opened: bool = True) -> dict:
        found = self.s.cursors.get(name.lower())
        if found is None:
            raise TSqlError(f"A cursor with the name '{name}' does not exist.", 16916)
        if opened and not found["open"]:
            raise TSqlError("Cursor is not open.", 16917)
        return found

    def do_open(self, st, eager) -> None:
        c = self.cursor(st.name, False)
        if c["open"]:
            raise TSqlError("The cursor is already open.", 16905)
        frame, _ = self.s.frame_of(c["query"])
        c.update(open=True, rows=[], source=frame.toLocalIterator(), at=-1, columns=frame.schema, done=False)

    def row(self, c: dict, n: int):
        """Row n, reading on as far as needed; n < 0 counts from the end."""
        while not c["done"] and (n < 0 or len(c["rows"]) <= n):
            try:
                c["rows"].append(next(c["source"]))
            except StopIteration:
                c["done"] = True
        if n < 0:
            n += len(c["rows"])
        return (n, c["rows"][n]) if 0 <= n < len(c["rows"]) else (n, None)

    def do_fetch(self, st, eager) -> None:
        c = self.cursor(st.name)
        k = int(self.value(st.n)) if st.n is not None else 0
        want = {"NEXT": c["at"] + 1, "PRIOR": c["at"] - 1, "FIRST": 0, "LAST": -1, "ABSOLUTE": k - 1 if k > 0 else k, "RELATIVE": c["at"] + k}[st.way]
        if st.way in ("PRIOR", "RELATIVE") and want < 0:
            c["at"], row = -1, None
        else:
            at, row = self.row(c, want)
            c["at"] = at if row is not None else len(c["rows"]) if want >= 0 else -1
        self.s.state["@@fetch_status"] = 0 if row is not None else -1
        if st.into:
            if row is not None:
                if len(st.into) != len(row):
                    raise TSqlError("Cursorfetch: The number of variables declared in the INTO list must match that of selected columns.", 16924)
                for name, value in zip(st.into, row):
                    self.put(name, "=", value)
        else:
            self.result.frames.append(self.s.spark.createDataFrame([row] if row is not None else [], c["columns"]))

    def do_close(self, st, eager) -> None:
        self.cursor(st.name).update(open=False, rows=[], source=None)

    def do_deallocate(self, st, eager) -> None:
        self.cursor(st.name, False)
        del self.s.cursors[st.name.lower()]

    # -- temporary tables and changes
    def do_create(self, st, eager) -> None:
        if not st.name.startswith("#"):
            raise unsupported("CREATE TABLE of a table that is not temporary")
        if st.name.lower() in self.s.temp:
            raise TSqlError(f"There is already an object named '{st.name}' in the database.", 2714)
        self.s.temp[st.name.lower()] = {"columns": {c: k for c, k, _ in st.columns}, "required": [c for c, _, null in st.columns if not null], "next": 0}
        schema = ", ".join(f"{ident(c)} {spark_type(k)}" for c, k, _ in st.columns)
        self.s.write_temp(st.name, self.s.spark.createDataFrame([], schema))

    def do_drop(self, st, eager) -> None:
        for name in st.names:
            if name.lower() not in self.s.temp:
                if st.quiet:
                    continue
                raise TSqlError(f"Cannot drop the table '{name}', because it does not exist or you do not have permission.", 3701)
            view, _ = self.s.views.pop(name.lower())
            del self.s.temp[name.lower()]
            self.s.spark.catalog.dropTempView(view)

    def target(self, name: str) -> dict:
        if name.lower() not in self.s.temp:
            self.s.table([name])
            raise unsupported(f"Changing '{name}', which is no temporary table,")
        return self.s.temp[name.lower()]

    def do_insert(self, st, eager) -> None:
        info = self.target(st.name)
        self.s.before_dml("insert", st.name)
        columns = st.columns or list(info["columns"])
        st.query.ctes = st.ctes + st.query.ctes
        frame, own = self.s.frame_of(st.query)
        if len(own) != len(columns):
            raise TSqlError("There are " + ("more" if len(columns) > len(own) else "fewer") + " columns in the INSERT statement than values specified in the VALUES clause.", 109 if len(columns) > len(own) else 110)
        known = {c.lower(): c for c in info["columns"]}
        for c in columns:
            if c.lower() not in known:
                raise TSqlError(f"Invalid column name '{c}'.", 207)
        given = {known[c.lower()]: F.col(f"__{i}") for i, c in enumerate(columns)}
        frame = frame.toDF(*(f"__{i}" for i in range(len(own))))
        parts = [(given[c] if c in given else F.lit(None)).cast(spark_type(k)).alias(c) for c, k in info["columns"].items()]
        new = frame.select(*parts)
        for c in info["required"]:
            new = new.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"Cannot insert the value NULL into column '{c}'."))).otherwise(F.col(c)))
        new = new.withColumn(HIDDEN, F.monotonically_increasing_id() + info["next"])
        old = self.s.frames[st.name.lower()]
        self.count(self.s.append_temp(st.name, new.select(old.columns)))
        self.s.state["@@identity"] = info["next"] - 1

    def count(self, n: int) -> None:
        self.s.state["@@rowcount"] = n
        self.result.rowcounts.append(n)

    def located(self, st) -> tuple[str, Query]:
        """(table, query of row identifiers): the rows that the statement names."""
        name = st.target[-1]
        ctes = {c[0].lower(): c for c in st.ctes}
        sources = st.source or [Table([name])]
        if name.lower() in ctes:  # a CTE over one table: its rows are the table's
            body = ctes[name.lower()][2].body
            if not isinstance(body, Select) or len(body.source) != 1 or not isinstance(body.source[0], Table) or body.group or body.distinct:
                raise TSqlError(f"View or function '{name}' is not updatable because the modification affects multiple base tables.", 4405)
            base_table = body.source[0]
            body.items.append((("col", [base_table.alias or base_table.parts[-1], HIDDEN]), HIDDEN, None, "="))
            return base_table.parts[-1], Query(Select([(("col", [name, HIDDEN]), HIDDEN, None, "=")], source=sources, where=st.where, top=st.top), ctes=st.ctes), name
        alias, table = name, name

        def walk(x):
            nonlocal table
            if isinstance(x, Table) and (x.alias or "").lower() == name.lower():
                table = x.parts[-1]
            for side in ("left", "right"):
                if hasattr(x, side):
                    walk(getattr(x, side))

        for x in sources:
            walk(x)
        return table, Query(Select([(("col", [alias, HIDDEN]), HIDDEN, None, "=")], source=sources, where=st.where, top=st.top), ctes=st.ctes), alias

    def do_delete(self, st, eager) -> None:
        if st.where is None and self.s.block["delete"]:
            raise TSqlError("DELETE without WHERE is blocked by your settings.", 40000)
        table, query, _ = self.located(st)
        self.target(table)
        self.s.before_dml("delete", table)
        gone = self.s.frame_of(query)[0].distinct()
        old = self.s.frames[table.lower()]
        before = old.count()
        self.s.write_temp(table, old.join(gone, HIDDEN, "left_anti").select(old.columns))
        self.count(before - self.s.frames[table.lower()].count())

    def do_update(self, st, eager) -> None:
        if st.where is None and not st.ctes and self.s.block["update"]:
            raise TSqlError("UPDATE without WHERE is blocked by your settings.", 40000)
        table, query, alias = self.located(st)
        info = self.target(table)
        self.s.before_dml("update", table)
        known = {c.lower(): c for c in info["columns"]}
        for i, (column, value) in enumerate(st.sets):
            if column.lower() not in known:
                raise TSqlError(f"Invalid column name '{column}'.", 207)
            query.body.items.append((value, f"__new{i}", None, "="))
        new = self.s.frame_of(query)[0].dropDuplicates([HIDDEN]).withColumn("__hit", F.lit(True))
        old = self.s.frames[table.lower()]
        joined = old.join(new, HIDDEN, "left")
        sets = {known[c.lower()]: i for i, (c, _) in enumerate(st.sets)}
        parts = [
            F.when(F.col("__hit"), F.col(f"__new{sets[c]}").cast(spark_type(info["columns"][c]))).otherwise(F.col(c)).alias(c) if c in sets else F.col(f"`{c}`")
            for c in old.columns
        ]
        n = new.count()
        self.s.write_temp(table, joined.select(*parts))
        self.count(n)


def _uses(x, names: set) -> bool:
    if isinstance(x, tuple) and x and x[0] == "var":
        return x[1].lower() in names
    return isinstance(x, (tuple, list)) and any(_uses(y, names) for y in x)
