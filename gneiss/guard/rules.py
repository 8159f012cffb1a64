"""What user SQL may do: one SELECT over allowed tables and columns, bound to one key, with a row limit.

The rules are tried in a fixed order and the first that is broken names the rejection. What passes is
rendered anew from the tree that was checked, in Spark's dialect; the rendered text is parsed again, and
runs only if that gives the same tree, so that nothing else can run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import DataFrame

from gneiss.guard.syntax import Call, Case, Cast, Extract, In, Literal, Name, Node, Op, Parser, Rejected, Select, Source, Star, Sub, _quote, rendered_tokens, tokenize

#: The functions that may be called.
FUNCTIONS = {"count", "sum", "min", "max", "avg", "coalesce", "nullif", "case", "cast", "upper", "lower", "trim", "length", "concat", "substring", "replace", "to_char", "date_trunc", "extract", "current_date", "now"}
#: Schemas that a table may be named with.
SCHEMAS = {"", "public"}
#: Patterns of to_char for times, and Spark's for them.
_PATTERN = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS"}
_PATTERN_PART = re.compile(r"(?P<field>YYYY|YY|MM|DD|HH24|HH12|MI|SS|MS)|\"(?P<text>[^\"]*)\"|(?P<other>[^\w\"])")
#: Types that Postgres divides without a remainder, and those of them that a sum leaves as they are.
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_TYPES = {"text": "STRING", "varchar": "STRING", "character varying": "STRING", "char": "STRING", "int": "INT", "int4": "INT", "integer": "INT", "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT", "numeric": "DECIMAL(38, 10)", "decimal": "DECIMAL(38, 10)", "real": "FLOAT", "float": "DOUBLE", "float8": "DOUBLE", "double precision": "DOUBLE", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "timestamp without time zone": "TIMESTAMP"}


@dataclass(frozen=True)
class ValidatedQuery:
    """A query that passed: Spark SQL, its limit, its output names, and those that are plain columns of a table."""

    sql: str
    limit: int
    output: tuple[str, ...]
    provenance: tuple[str, ...]


@dataclass
class Scope:
    select: Select
    parent: Scope | None
    sources: dict[str, _Relation] = field(default_factory=dict)
    inner: dict[int, Scope] = field(default_factory=dict)  # id of a subquery -> its scope


@dataclass
class _Relation:
    columns: tuple[str, ...]
    base: str | None
    kinds: tuple[str, ...] = ()  # a Spark type per column where it is an integral one, else empty


def _walk(node: Node | None) -> Iterator[Node]:
    """The nodes of an expression, without those inside subqueries."""
    if node is None:
        return
    yield node
    for c in node.children():
        yield from _walk(c)


def _expressions(s: Select) -> Iterator[tuple[str, Node]]:
    for p in s.projections:
        yield "select", p.expr
    for src in s.sources:
        if src.on is not None:
            yield "on", src.on
    if s.where is not None:
        yield "where", s.where
    for g in s.group:
        yield "group", g
    if s.having is not None:
        yield "having", s.having
    for o, _ in s.order:
        yield "order", o


def _selects(s: Select) -> Iterator[Select]:
    """Every SELECT, from the outside in."""
    yield s
    for _, c, _ in s.ctes:
        yield from _selects(c)
    for src in s.sources:
        if src.select is not None:
            yield from _selects(src.select)
    for _, e in _expressions(s):
        for n in _walk(e):
            if isinstance(n, Sub):
                yield from _selects(n.select)


class _Analysis:
    def __init__(self, root: Select, whitelist: dict[str, tuple[str, ...]], scope_column: str, key: str, types: dict[str, dict[str, str]] | None = None):
        self.root, self.whitelist, self.column, self.key, self.types = root, whitelist, scope_column, key, types or {}
        self.scopes: list[Scope] = []
        self.scope_of: dict[int, Scope] = {}
        self.bases = 0

    # Scopes and sources.
    def build(self, s: Select, parent: Scope | None, ctes: dict[str, _Relation]) -> Scope:
        if s.recursive:
            raise Rejected("unsupported_source", "WITH RECURSIVE")
        scope = self.scope_of[id(s)] = Scope(s, parent)
        self.scopes.append(scope)
        known = dict(ctes)
        for name, body, listed in s.ctes:
            if body.set_operation or listed:
                raise Rejected("unsupported_source", name)
            inner = self.build(body, None, known)
            known[name] = _Relation(self.output(inner), None, self.output_kinds(inner))
        for src in s.sources:
            rel = self.relation(src, scope, known)
            if src.name in scope.sources:
                raise Rejected("duplicate_source", src.name)
            scope.sources[src.name] = rel
        for _, e in _expressions(s):
            for n in _walk(e):
                if isinstance(n, Sub):
                    if n.select.set_operation:
                        raise Rejected("unsupported_source", "set operation")
                    scope.inner[id(n.select)] = self.build(n.select, scope, known)
        return scope

    def relation(self, src: Source, scope: Scope, ctes: dict[str, _Relation]) -> _Relation:
        if src.select is not None:
            if src.select.set_operation or src.columns:
                raise Rejected("unsupported_source", src.name)
            inner = self.build(src.select, scope.parent, ctes)
            return _Relation(self.output(inner), None, self.output_kinds(inner))
        if src.function:
            raise Rejected("unknown_table", src.parts[-1])
        if len(src.parts) == 1 and src.parts[0] in ctes:
            if src.columns:
                raise Rejected("unsupported_source", src.name)
            return ctes[src.parts[0]]
        if len(src.parts) > 2 or ".".join(src.parts[:-1]) not in SCHEMAS or src.parts[-1] not in self.whitelist:
            raise Rejected("unknown_table", ".".join(src.parts))
        if src.columns:
            raise Rejected("unsupported_source", src.name)
        self.bases += 1
        name = src.parts[-1]
        return _Relation(self.whitelist[name], name, tuple(self.types.get(name, {}).get(c, "") for c in self.whitelist[name]))

    def output(self, scope: Scope) -> tuple[str, ...]:
        names: list[str] = []
        for p in scope.select.projections:
            if isinstance(p.expr, Star):
                for n, rel in scope.sources.items():
                    if p.expr.qualifier in (None, n):
                        names += rel.columns
            else:
                names.append(p.alias or _implied(p.expr))
        return tuple(names)

    # Integral types, for Postgres divides two of them without a remainder.
    def output_kinds(self, scope: Scope) -> tuple[str, ...]:
        kinds: list[str] = []
        for p in scope.select.projections:
            if isinstance(p.expr, Star):
                for n, rel in scope.sources.items():
                    if p.expr.qualifier in (None, n):
                        kinds += rel.kinds or [""] * len(rel.columns)
            else:
                kinds.append(self.kind(p.expr, scope))
        return tuple(kinds)

    def kind(self, n: Node, scope: Scope | None) -> str:
        """int or bigint for an integral expression, null for a bare NULL, else empty."""
        n = _bare(n)
        if isinstance(n, Literal):
            return "null" if n.text == "NULL" else "int" if isinstance(n.value, int) and not isinstance(n.value, bool) else ""
        if isinstance(n, Name):
            while scope is not None:
                for name, rel in scope.sources.items():
                    if n.qualifier in (None, name) and n.parts[-1] in rel.columns:
                        k = dict(zip(rel.columns, rel.kinds)).get(n.parts[-1], "")
                        return k if k in _INTEGRAL else ""
                scope = scope.parent
            return ""
        if isinstance(n, Sub):
            return "" if n.exists else (self.output_kinds(self.scope_of[id(n.select)]) or ("",))[0]
        if isinstance(n, Cast):
            k = _TYPES.get(n.kind.split(" (")[0], "").lower()
            return k if k in _INTEGRAL else ""
        if isinstance(n, Case):
            return self.widest([*(b for _, b in n.whens), *([n.default] if n.default is not None else [])], scope)
        if isinstance(n, Op) and (n.op.startswith("sign") or n.op in ("+", "-", "*", "/", "%")):
            return self.widest(n.args, scope)
        if isinstance(n, Call):
            if n.name in ("count", "length"):
                return "bigint" if n.name == "count" else "int"
            if n.name in ("min", "max", "coalesce"):
                return self.widest(n.args, scope)
            if n.name == "nullif":
                return self.kind(n.args[0], scope)
            if n.name == "sum":  # of bigint it is numeric in Postgres
                return "bigint" if self.widest(n.args, scope) not in ("", "null", "bigint") else ""
        return ""

    def widest(self, args: list[Node], scope: Scope | None) -> str:
        kinds = [k for k in (self.kind(a, scope) for a in args) if k != "null"]
        return "" if not kinds or "" in kinds else "bigint" if "bigint" in kinds else "int"

    # Columns.
    def resolve(self, name: Name, scope: Scope | None, aliases: set[str]) -> None:
        first, top = True, scope
        while scope is not None:
            if name.qualifier is not None:
                if name.qualifier in scope.sources:
                    if name.parts[-1] not in scope.sources[name.qualifier].columns:
                        raise Rejected("unknown_column", ".".join(name.parts))
                    return
            elif any(name.parts[0] in r.columns for r in scope.sources.values()):
                return
            elif first and name.parts[0] in aliases:
                return
            first, scope = False, scope.parent
        if name.qualifier is not None:
            raise Rejected("unknown_table", name.qualifier)
        raise Rejected("unknown_column", f"{name.parts[-1]} in {list(top.sources) if top else []}")

    def columns(self) -> None:
        for scope in self.scopes:
            outputs = {p.alias for p in scope.select.projections if p.alias}
            for where, e in _expressions(scope.select):
                for n in _walk(e):
                    if isinstance(n, Name):
                        self.resolve(n, scope, outputs if where in ("group", "order") else set())
                    elif isinstance(n, Star) and n.qualifier is not None and n.qualifier not in scope.sources:
                        raise Rejected("unknown_table", n.qualifier)
            seen: list[_Relation] = []
            for src in scope.select.sources:
                rel = scope.sources[src.name]
                for c in src.using:
                    if c not in rel.columns or not any(c in r.columns for r in seen):
                        raise Rejected("unknown_column", c)
                seen.append(rel)

    def functions(self) -> None:
        for s in _selects(self.root):
            for _, e in _expressions(s):
                for n in _walk(e):
                    if isinstance(n, Call) and n.name not in FUNCTIONS:
                        raise Rejected("forbidden_function", n.name)

    # The proof that every table is read for one key only.
    def bound(self, scope: Scope) -> None:
        bases = {n for n, r in scope.sources.items() if r.base and self.column in r.columns}
        holds: set[str] = set()
        for e in (scope.select.where, *[src.on for src in scope.select.sources]):
            for c in _conjuncts(e):
                holds |= self.binds(c, bases)
        if bases - holds or any(r.base and self.column not in r.columns for r in scope.sources.values()):
            raise Rejected("order_scope", ", ".join(sorted(bases - holds)))

    def binds(self, c: Node, bases: set[str]) -> set[str]:
        if isinstance(c, Op) and c.op == "=":
            a, b = (_bare(x) for x in c.args)
            if isinstance(a, Literal):
                a, b = b, a
            ok = isinstance(b, Literal) and b.value == self.key
        elif isinstance(c, In) and not c.negated:
            a, ok = _bare(c.arg), bool(c.items) and all(isinstance(i, Literal) and i.value == self.key for i in map(_bare, c.items))
        else:
            return set()
        if not ok or not isinstance(a, Name) or a.parts[-1] != self.column:
            return set()
        if a.qualifier is not None:
            return {a.qualifier} & bases
        return bases if len(bases) == 1 else set()


def _bare(n: Node) -> Node:
    while isinstance(n, Op) and n.op == "()":
        n = n.args[0]
    return n


def _conjuncts(n: Node | None) -> Iterator[Node]:
    if n is None:
        return
    n = _bare(n)
    if isinstance(n, Op) and n.op == "AND":
        for a in n.args:
            yield from _conjuncts(a)
    else:
        yield n


def _implied(e: Node) -> str:
    """The name of an expression without an alias; empty if it has none."""
    e = _bare(e)
    return e.parts[-1] if isinstance(e, Name) else e.name if isinstance(e, Call) else _implied(e.arg) if isinstance(e, Cast) else "case" if isinstance(e, Case) else "extract" if isinstance(e, Extract) else ""


def validate_sql(sql: str, *, order_no: str, max_rows: int, whitelist: dict[str, tuple[str, ...]], scope_column: str = "order_no", views: dict[str, str] | None = None, types: dict[str, dict[str, str]] | None = None) -> ValidatedQuery:
    """Check a query and rewrite it for Spark; ``Rejected`` names the first rule that it breaks.

    whitelist: table to columns; every table must be bound to ``scope_column = order_no``. ``views``
    gives the view to read for a table, ``types`` the Spark type of its columns (integral ones divide
    without a remainder). Wrong arguments of the caller raise ValueError.
    """
    if not order_no or isinstance(max_rows, bool) or not isinstance(max_rows, int) or max_rows < 1:
        raise ValueError("order_no and a positive max_rows are needed")
    if not sql or not sql.strip():
        raise Rejected("empty")
    tokens = tokenize(sql)
    while tokens and tokens[-1].text == ";":
        tokens.pop()
    if not tokens:
        raise Rejected("empty")
    if any(t.kind == "op" and t.text == ";" for t in tokens):
        raise Rejected("multiple_statements")
    root = Parser(tokens).statement()
    every = list(_selects(root))
    if root.set_operation:
        raise Rejected("not_select", "set operation")
    if any(s.into for s in every):
        raise Rejected("forbidden_statement", "INTO")
    if any(s.lock for s in every):
        raise Rejected("locking_clause")
    for s in every:
        for src in s.sources[1:]:
            if src.joined not in ("INNER", "CROSS") or src.natural:
                raise Rejected("unsupported_join", src.joined)
    a = _Analysis(root, whitelist, scope_column, order_no, types)
    top = a.build(root, None, {})
    if not a.bases:
        raise Rejected("no_whitelisted_table")
    a.columns()
    a.functions()
    if any(isinstance(_bare(p.expr), Literal) for p in root.projections):
        raise Rejected("unsupported_projection", "a bare literal")
    output = a.output(top)
    named = [n for n in output if n]
    if len(set(named)) < len(named):
        raise Rejected("unsupported_projection", "an output name occurs twice")
    for scope in a.scopes:
        a.bound(scope)
    limit = _limit(root, max_rows)
    safe: list[str] = []
    for p in root.projections:
        if isinstance(p.expr, Star):
            safe += [c for n, r in top.sources.items() if r.base and p.expr.qualifier in (None, n) for c in r.columns]
        elif isinstance(p.expr, Name) and (p.expr.qualifier is None and sum(p.expr.parts[-1] in r.columns for r in top.sources.values()) == 1 and next(r for r in top.sources.values() if p.expr.parts[-1] in r.columns).base or p.expr.qualifier in top.sources and top.sources[p.expr.qualifier].base):
            safe.append(p.alias or p.expr.parts[-1])
    root.limit, root.limit_form = Literal(str(limit), limit), ""
    spark_tree = _Rewriter(a, views or {}).select(root)
    text = _Writer().select(spark_tree)
    if _shape(Parser(rendered_tokens(text), rendered=True).statement()) != _shape(spark_tree):
        raise Rejected("parse_error", "the rendered text isn't what was checked")
    return ValidatedQuery(text, limit, output, tuple(safe))


def _limit(s: Select, most: int) -> int:
    if s.limit_form:
        raise Rejected("unsupported_limit", s.limit_form)
    if s.limit is None or isinstance(s.limit, Name) and s.limit.parts == ["all"]:
        return most
    n = _bare(s.limit)
    if not isinstance(n, Literal) or isinstance(n.value, bool) or not isinstance(n.value, int) or n.value < 1:
        raise Rejected("unsupported_limit")
    return min(n.value, most)


def _id(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _shape(n: object) -> object:
    """A tree as nested tuples, without brackets."""
    if isinstance(n, Op) and n.op == "()":
        return _shape(n.args[0])
    if is_dataclass(n):
        return (type(n).__name__, *(_shape(getattr(n, f.name)) for f in fields(n)))
    return tuple(map(_shape, n)) if isinstance(n, (list, tuple)) else n


class _Rewriter:
    """The checked tree in Spark's terms: its functions, types and views."""

    def __init__(self, analysis: _Analysis, views: dict[str, str]):
        self.analysis, self.views = analysis, views

    def select(self, s: Select, ctes: frozenset[str] = frozenset()) -> Select:
        bodies = []
        for name, body, listed in s.ctes:
            bodies.append((name, self.select(body, ctes), listed))
            ctes |= {name}
        scope = self.analysis.scope_of[id(s)]
        e = lambda n: None if n is None else self.expr(n, scope, ctes)
        sources = []
        for src in s.sources:
            parts = src.parts if src.select is not None or len(src.parts) == 1 and src.parts[0] in ctes else [self.views.get(src.parts[-1], src.parts[-1])]
            sources.append(replace(src, parts=parts, alias=src.name, select=None if src.select is None else self.select(src.select, ctes), on=e(src.on)))
        return replace(
            s, ctes=bodies, sources=sources, projections=[replace(p, expr=e(p.expr)) for p in s.projections], where=e(s.where), group=[e(g) for g in s.group], having=e(s.having),
            # Postgres puts nulls last when rising and first when falling.
            order=[(e(o), how if "NULLS" in how else f"{how} NULLS {'FIRST' if how == 'DESC' else 'LAST'}") for o, how in s.order],
            limit=e(s.limit), offset=e(s.offset),
        )

    def expr(self, n: Node, scope: Scope, ctes: frozenset[str]) -> Node:
        e = lambda x: None if x is None else self.expr(x, scope, ctes)
        if isinstance(n, Name):
            return Name(n.parts[-2:])
        if isinstance(n, Sub):
            return Sub(self.select(n.select, ctes), n.exists)
        if isinstance(n, In):
            return In(e(n.arg), [e(i) for i in n.items], n.negated)
        if isinstance(n, Cast):
            kind = n.kind.split(" (")[0]
            if kind not in _TYPES:
                raise Rejected("parse_error", f"type {n.kind}")
            return Cast(e(n.arg), _TYPES[kind].lower().replace("(38, 10)", " (38,10)").replace("  ", " "))
        if isinstance(n, Extract):
            if n.part == "dow":  # from 0 in Postgres, from 1 in Spark
                return Op("-", [Extract("dayofweek", e(n.arg)), Literal("1", 1)])
            return Extract("dayofweek_iso" if n.part == "isodow" else n.part, e(n.arg))
        if isinstance(n, Case):
            return Case(e(n.subject), [(e(a), e(b)) for a, b in n.whens], e(n.default))
        if isinstance(n, Op):
            op = "DIV" if n.op == "/" and all(self.analysis.kind(a, scope) in _INTEGRAL for a in n.args) else n.op
            return Op(op, [e(a) for a in n.args])
        if isinstance(n, Call):
            args = [e(a) for a in n.args]
            if n.name == "concat":  # Postgres leaves nulls out
                return Call("concat_ws", [Literal("''", ""), *args])
            if n.name == "to_char":
                if len(n.args) != 2 or not isinstance(n.args[1], Literal):
                    raise Rejected("parse_error", "to_char")
                pattern = _spark_pattern(str(n.args[1].value))
                return Call("date_format", [args[0], Literal(_quote(pattern), pattern)])
            return replace(n, args=args)
        return n


def _spark_pattern(pattern: str) -> str:
    """A pattern of to_char as one of date_format; fields that aren't known are rejected."""
    out, at = "", 0
    while at < len(pattern):
        m = _PATTERN_PART.match(pattern, at)
        if not m:
            raise Rejected("parse_error", f"to_char {pattern[at:]!r}")
        at = m.end()
        if m.group("field"):
            out += _PATTERN[m.group("field")]
        else:
            plain = m.group("text") if m.group("text") is not None else m.group("other")
            out += plain if not re.search(r"[\w'\[\]{}#]", plain) else "'" + plain.replace("'", "''") + "'"
    return out


class _Writer:
    """Renders a tree in Spark's terms as text. Every operand that is an operation stands in brackets."""

    def select(self, s: Select) -> str:
        out = "WITH " + ", ".join(f"{_id(name)} AS ({self.select(body)})" for name, body, _ in s.ctes) + " " if s.ctes else ""
        cols = ", ".join(self.expr(p.expr) + (f" AS {_id(p.alias)}" if p.alias else "") for p in s.projections)
        out += f"SELECT {'DISTINCT ' if s.distinct else ''}{cols}"
        for i, src in enumerate(s.sources):
            out += " FROM " if not i else f" {src.joined} JOIN "
            out += (f"({self.select(src.select)})" if src.select is not None else _id(src.parts[-1])) + f" AS {_id(src.name)}"
            if src.on is not None:
                out += f" ON {self.expr(src.on)}"
            if src.using:
                out += f" USING ({', '.join(map(_id, src.using))})"
        if s.where is not None:
            out += f" WHERE {self.expr(s.where)}"
        if s.group:
            out += " GROUP BY " + ", ".join(map(self.expr, s.group))
        if s.having is not None:
            out += f" HAVING {self.expr(s.having)}"
        if s.order:
            out += " ORDER BY " + ", ".join(f"{self.expr(e)} {how}" for e, how in s.order)
        if s.limit is not None:
            out += f" LIMIT {self.expr(s.limit)}"
        if s.offset is not None:
            out += f" OFFSET {self.expr(s.offset)}"
        return out

    def operand(self, n: Node) -> str:
        text = self.expr(n)
        return text if isinstance(n, (Literal, Name, Call, Cast, Extract)) or isinstance(n, Op) and n.op == "()" or isinstance(n, Sub) and not n.exists else f"({text})"

    def expr(self, n: Node) -> str:
        e, o = self.expr, self.operand
        if isinstance(n, Literal):
            return n.text
        if isinstance(n, Name):
            return ".".join(map(_id, n.parts))
        if isinstance(n, Star):
            return f"{_id(n.qualifier)}.*" if n.qualifier else "*"
        if isinstance(n, Sub):
            return f"{'EXISTS ' if n.exists else ''}({self.select(n.select)})"
        if isinstance(n, In):
            inner = self.select(n.items[0].select) if isinstance(n.items[0], Sub) else ", ".join(map(e, n.items))
            return f"{o(n.arg)} {'NOT ' if n.negated else ''}IN ({inner})"
        if isinstance(n, Cast):
            return f"CAST({e(n.arg)} AS {n.kind.upper()})"
        if isinstance(n, Extract):
            return f"EXTRACT({n.part} FROM {e(n.arg)})"
        if isinstance(n, Case):
            return f"CASE {e(n.subject) + ' ' if n.subject is not None else ''}" + " ".join(f"WHEN {e(a)} THEN {e(b)}" for a, b in n.whens) + (f" ELSE {e(n.default)}" if n.default is not None else "") + " END"
        if isinstance(n, Call):
            if n.name == "current_date":
                return n.name
            return f"{n.name}({'*' if n.star else ('DISTINCT ' if n.distinct else '') + ', '.join(map(e, n.args))})"
        assert isinstance(n, Op)
        if n.op == "()":
            return f"({e(n.args[0])})"
        if n.op.startswith("sign"):  # brackets, for two signs would open a comment
            return f"{n.op[4:]}({e(n.args[0])})"
        if n.op == "NOT":
            return f"NOT {o(n.args[0])}"
        if n.op == "BETWEEN":
            return f"{o(n.args[0])} BETWEEN {o(n.args[1])} AND {o(n.args[2])}"
        return f"{o(n.args[0])} {n.op}" + (f" {o(n.args[1])}" if len(n.args) == 2 else "")


def describe(whitelist: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """What a writer of queries is told: the tables with their columns, a line each, and the functions."""
    return "\n".join(f"- {name}({', '.join(columns)})" for name, columns in whitelist.items()), ", ".join(sorted(FUNCTIONS))


def execute(tables: dict[str, DataFrame], sql: str, *, order_no: str, max_rows: int, scope_column: str = "order_no", tag: str = "guard") -> DataFrame:
    """Check the query, then run what was checked over exactly these tables, as temporary views."""
    some = next(iter(tables.values()))
    views = {name: f"{tag}_{name}" for name in tables}
    checked = validate_sql(sql, order_no=order_no, max_rows=max_rows, whitelist={n: tuple(t.columns) for n, t in tables.items()}, scope_column=scope_column, views=views, types={n: dict(t.dtypes) for n, t in tables.items()})
    for name, t in tables.items():
        t.createOrReplaceTempView(views[name])
    return some.sparkSession.sql(checked.sql)
