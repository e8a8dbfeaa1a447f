"""The query builder: one SELECT block, lowered to DataFrame operations.

The order is joins, where, group by, project, sort, limit, however the calls came. Nothing runs until the DataFrame does. Where tables have
statistics, the planner beside this module orders the joins and picks indices; the rest is Catalyst's: filters reach the scans, columns are
pruned, joins are run by size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ResolutionError
from ..functions import aggregates
from ..functions.expressions import Binary, Call, Expr, Literal, Name, Scope, Star, Typed, aggregated, calls, compare, free_names, lower, parse_expr, truth
from ..operators import joins, ordering, scans
from ..stats import TableStats
from ..types import kind_of
from . import planner


@dataclass
class Joined:
    table: str
    alias: str
    left: str | None = None
    right: str | None = None
    strategy: str | None = None


@dataclass
class Output:
    expr: Expr
    name: str | None = None


@dataclass
class QueryPlan:
    """`tables` gives a table's DataFrame by name, `stats` its statistics or None, `indices` the lower-case names of its indexed columns.
    Methods return the plan, so calls chain.

    `order` names the column that FIRST, LAST and the rows of GROUP BY without aggregates go by; without it, the order of the scan.
    `empty_aggregate`: "row" gives one row for a global aggregate over nothing, "none" gives no row."""

    tables: Callable[[str], DataFrame]
    sources: list[Joined] = field(default_factory=list)
    conditions: list[Expr] = field(default_factory=list)
    outputs: list[Output] | None = None
    groups: list[str] = field(default_factory=list)
    sorts: list[tuple[str, bool]] = field(default_factory=list)
    count: int = -1
    skip: int = 0
    order: str | None = None
    empty_aggregate: str = "row"
    seed: int | None = None
    stats: Callable[[str], TableStats | None] | None = None
    indices: Callable[[str], set[str] | None] | None = None

    # building

    def start(self, table: str, alias: str | None = None) -> QueryPlan:
        self.sources.append(Joined(table, alias or table))
        return self

    def join(self, table: str, left: str, right: str, alias: str | None = None, strategy: str | None = None) -> QueryPlan:
        """An inner join on two qualified columns, one of them of the new table, in either order."""
        alias = alias or table
        if alias.lower() in [s.alias.lower() for s in self.sources]:
            raise ResolutionError(f"table or alias {alias} is in use")
        if "." not in left or "." not in right:
            raise ResolutionError("join columns need their table's name")
        mine = [c.split(".")[0].lower() == alias.lower() for c in (left, right)]
        if mine[0] == mine[1]:
            raise ResolutionError(f"one side of ON must be of {alias}, the other of a table before it")
        self.sources.append(Joined(table, alias, right if mine[0] else left, left if mine[0] else right, strategy))
        return self

    def where(self, column: str, op: str, value: object) -> QueryPlan:
        """A comparison of a column with a value; several are joined by AND."""
        from ..functions.expressions import COMPARISONS

        self.conditions.append(Binary(COMPARISONS[op], Name(column), Literal(value)))
        return self

    def where_expr(self, condition: Expr | str) -> QueryPlan:
        self.conditions.append(parse_expr(condition) if isinstance(condition, str) else condition)
        return self

    def group_by(self, *columns: str) -> QueryPlan:
        self.groups = list(columns)
        return self

    def project(self, *items: str | Output) -> QueryPlan:
        """Expressions, as text (which may end in AS name) or parsed; once for each plan."""
        if self.outputs is not None:
            raise EngineError("a plan projects once")
        if not items:
            raise EngineError("a projection needs columns")
        from .sql import parse_output

        self.outputs = [parse_output(i) if isinstance(i, str) else i for i in items]
        return self

    def sort(self, column: str, descending: bool = False) -> QueryPlan:
        self.sorts.append((column, descending))
        return self

    def limit(self, n: int, offset: int = 0) -> QueryPlan:
        self.count, self.skip = n, offset
        return self

    def ordered_by(self, column: str) -> QueryPlan:
        self.order = column
        return self

    # lowering

    def _scan(self, s: Joined, index: tuple[str, str, object] | None = None) -> tuple[DataFrame, list[tuple[str | None, str, str, str]]]:
        df = self.tables(s.table)
        if index:
            df = scans.predicate(df, *index)
        inner = [f"{s.alias}.{c}" for c in df.columns]
        return df.toDF(*inner), [(s.alias, c, n, kind_of(f.dataType)) for c, n, f in zip(df.columns, inner, df.schema.fields, strict=True)]

    def _from(self) -> tuple[DataFrame, Scope]:
        if not self.sources:
            raise EngineError("a plan needs a table")
        found = planner.planned(self)
        sources = found.sources if found else self.sources

        def scan(s: Joined) -> tuple[DataFrame, list[tuple[str | None, str, str, str]]]:
            return self._scan(s, found.access[s.alias].index if found else None)

        df, columns = scan(sources[0])
        for s in sources[1:]:
            right, more = scan(s)
            left_key, left_kind = Scope(columns).find(s.left)
            right_key, right_kind = Scope(more).find(s.right)
            compare("=", (F.lit(None), left_kind), (F.lit(None), right_kind))
            df = joins.equi_join(df, right, left_key, right_key, s.strategy)
            columns = columns + more
        # names resolve, and stars expand, in the order that was written
        written = [s.alias for s in self.sources]
        return df, Scope(sorted(columns, key=lambda c: written.index(c[0])))

    def _expanded(self, scope: Scope) -> list[Output]:
        """Outputs with stars replaced by columns. `*` names columns by their table if there are several tables, `t.*` always."""
        out: list[Output] = []
        for o in self.outputs if self.outputs is not None else [Output(Star())]:
            if not isinstance(o.expr, Star):
                out.append(o)
                continue
            t = o.expr.table
            found = [c for c in scope.columns if t is None or c[0].lower() == t.lower()]
            if not found:
                raise ResolutionError(f"unknown table {t}")
            out += [Output(Name(f"{a}.{c}"), f"{a}.{c}" if t is not None or len(self.sources) > 1 else c) for a, c, _, _ in found]
        return out

    def _aggregate(self, scope: Scope) -> Callable[[Call], Typed]:
        def lowered(call: Call) -> Typed:
            star = isinstance(call.args[0], Star)
            column, kind = (None, "int") if star else lower(call.args[0], scope)
            return aggregates.aggregate(call.name, column, kind)

        return lowered

    def _grouped(self, df: DataFrame, scope: Scope, outputs: list[Output], names: list[str]) -> DataFrame:
        keys = [scope.find(g)[0] for g in self.groups]
        has = any(aggregated(o.expr) for o in outputs)
        plain = [o for o in outputs if has and not aggregated(o.expr)] + [o for o in outputs if aggregated(o.expr)] if has else []
        for o in plain:
            for n in free_names(o.expr):
                if scope.find(n)[0] not in keys:
                    raise EngineError(f"{o.expr.text or n} uses {n}, which is not grouped")
        if not has or any(calls(o.expr, "FIRST", "LAST") for o in outputs):
            # rows in the order of the scan, unless a column is named
            df = df.withColumn(aggregates.ORDER, F.col(f"`{scope.find(self.order)[0]}`") if self.order else F.monotonically_increasing_id())
        if any(calls(o.expr, "RANDOM") for o in outputs):
            df = df.withColumn(aggregates.CHANCE, F.rand(self.seed))
        found: list[Column] = []
        for i, o in enumerate(outputs):
            c, _ = lower(o.expr, scope, self._aggregate(scope))
            if not aggregated(o.expr):
                # of a group's rows, the first: all agree where only keys are used
                c = F.first(c) if has else F.min_by(c, F.col(aggregates.ORDER))
            found.append(c.alias(f"__{i}"))
        grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*found, F.count(F.lit(1)).alias("__rows"))
        if not keys and self.empty_aggregate == "none":
            grouped = grouped.where("__rows > 0")
        return grouped.select(*[F.col(f"__{i}") for i in range(len(outputs))]).toDF(*names)

    def to_df(self) -> DataFrame:
        df, scope = self._from()
        for c in self.conditions:
            if aggregated(c):
                raise EngineError("aggregates cannot stand in WHERE")
            df = df.where(truth(lower(c, scope)))
        outputs = self._expanded(scope)
        names = [o.name or o.expr.text or o.expr.name for o in outputs]
        # names may repeat, so rows carry numbers until sort and limit are done
        inner = [f"__out{i}" for i in range(len(outputs))]
        if self.groups or any(aggregated(o.expr) for o in outputs):
            df = self._grouped(df, scope, outputs, inner)
        else:
            df = df.select(*[lower_output(o.expr, scope).alias(n) for o, n in zip(outputs, inner, strict=True)])
        if self.sorts:
            seen = Scope([(None, n, i, "other") for n, i in zip(names, inner, strict=True)])
            df = ordering.sort(df, [(self._sort_key(seen, c), down) for c, down in self.sorts])
        if self.count >= 0 or self.skip:
            df = ordering.limit(df, self.count, self.skip)
        return df.toDF(*names)

    def _sort_key(self, seen: Scope, name: str) -> str:
        """An output column; a qualified name also means the output of its bare name, and the other way round, if that is unique."""
        try:
            return seen.find(name)[0]
        except ResolutionError:
            tail = name.split(".")[-1].lower()
            near = [inner for _, n, inner, _ in seen.columns if n.split(".")[-1].lower() == tail and ("." not in name or "." not in n)]
            if len(near) != 1:
                raise
            return near[0]

    def explain(self, physical: bool = False) -> str:
        from .explain import tree

        if physical:
            return self.to_df()._jdf.queryExecution().explainString(self.to_df().sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return tree(self)

    def to_sql(self) -> str:
        """The plan as text of the dialect."""
        items = ["*"] if self.outputs is None else [shown(o.expr) + (f" AS {o.name}" if o.name else "") for o in self.outputs]
        out = f"SELECT {', '.join(items)} FROM {_source(self.sources[0])}"
        for s in self.sources[1:]:
            out += f" INNER JOIN {_source(s)} ON {s.left} = {s.right}"
        if self.conditions:
            out += " WHERE " + " AND ".join(shown(c) for c in self.conditions)
        if self.groups:
            out += " GROUP BY " + ", ".join(self.groups)
        if self.sorts:
            out += " ORDER BY " + ", ".join(c + (" DESC" if d else "") for c, d in self.sorts)
        if self.count >= 0:
            out += f" LIMIT {self.count}"
        return out + (f" OFFSET {self.skip}" if self.skip else "")


def _source(s: Joined) -> str:
    return s.table if s.alias == s.table else f"{s.table} AS {s.alias}"


def lower_output(e: Expr, scope: Scope) -> Column:
    """Plain columns keep their type; anything computed has the type of its kind."""
    if isinstance(e, Name):
        return F.col(f"`{scope.find(e.name)[0]}`")
    return lower(e, scope)[0]


def shown(e: Expr) -> str:
    if isinstance(e, Literal):
        return "'" + e.value.replace("'", "''") + "'" if isinstance(e.value, str) else str(e.value).lower() if isinstance(e.value, bool) else str(e.value)
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Star):
        return f"{e.table}.*" if e.table else "*"
    if isinstance(e, Call):
        return f"{e.name}({', '.join(shown(a) for a in e.args)})"
    if isinstance(e, Binary):
        return f"({shown(e.left)} {e.op} {shown(e.right)})"
    return f"{e.op}{shown(e.arg)}"
