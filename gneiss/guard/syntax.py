"""Lexer and parser of the SELECT dialect that users may write.

The dialect is Postgres' as far as the guard allows it. Statements that Spark's parser would refuse are
understood here too, because the guard must name the rule they break.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Rejected(ValueError):
    """A query that the guard doesn't let through; ``rule`` names why."""

    def __init__(self, rule: str, detail: str = ""):
        super().__init__(f"{rule}: {detail}" if detail else rule)
        self.rule = rule


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, number, op, end
    text: str

    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+)
    | (?P<comment>--|/\*)
    | (?P<string>[eE]'(?:[^'\\]|\\.|'')*'|[nN]'(?:[^']|'')*'|[uU]&'(?:[^']|'')*'|'(?:[^']|'')*'|(?P<tag>\$(?:[A-Za-z_]\w*)?\$)[\s\S]*?(?P=tag))
    | (?P<quoted>"(?:[^"]|"")+")
    | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    | (?P<word>[^\W\d]\w*)
    | (?P<op>::|\|\||<>|!=|<=|>=|[-+*/%=<>(),.;\[\]])""",
    re.X,
)


#: What the renderer writes: Spark's strings have backslash escapes, its quoted names backticks.
_RENDERED = re.compile(
    r"""(?P<space>\s+)
    | (?P<comment>--|/\*)
    | (?P<string>'(?:[^'\\]|\\.)*')
    | (?P<quoted>`(?:[^`]|``)+`)
    | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    | (?P<word>[^\W\d]\w*)
    | (?P<op>\|\||<=>|<>|<=|>=|[-+*/%=<>(),.])""",
    re.X | re.DOTALL,
)


def rendered_tokens(sql: str) -> list[Token]:
    """Tokens of a text as Spark reads it, in the parser's own notation; anything else is rejected."""
    out, at = [], 0
    while at < len(sql):
        m = _RENDERED.match(sql, at)
        if not m or m.lastgroup == "comment":
            raise Rejected("parse_error", f"rendered at {sql[at:at + 20]!r}")
        at, text = m.end(), m.group()
        if m.lastgroup == "string":
            text = "'" + _unquote(text).replace("'", "''") + "'"
        elif m.lastgroup == "quoted":
            text = '"' + text[1:-1].replace("``", "`").replace('"', '""') + '"'
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, text))
    return out


def tokenize(sql: str) -> list[Token]:
    """Tokens of the text. A comment anywhere outside strings is rejected: parsers drop them silently."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise Rejected("parse_error", f"at {sql[at:at + 20]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "tag" else "string"
        if kind == "comment":
            raise Rejected("comment")
        if kind != "space":
            out.append(Token(kind, m.group()))
    return out


# --- the tree ----------------------------------------------------------------------------------


@dataclass
class Node:
    def children(self) -> list[Node]:
        return []


@dataclass
class Literal(Node):
    text: str  # as Spark writes it
    value: object = None


@dataclass
class Name(Node):
    parts: list[str]

    @property
    def qualifier(self) -> str | None:
        return self.parts[-2] if len(self.parts) > 1 else None


@dataclass
class Star(Node):
    qualifier: str | None = None


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    distinct: bool = False
    star: bool = False

    def children(self):
        return self.args


@dataclass
class Op(Node):
    op: str
    args: list[Node]

    def children(self):
        return self.args


@dataclass
class Case(Node):
    subject: Node | None
    whens: list[tuple[Node, Node]]
    default: Node | None

    def children(self):
        return [x for x in (self.subject, *(y for w in self.whens for y in w), self.default) if x is not None]


@dataclass
class Cast(Node):
    arg: Node
    kind: str

    def children(self):
        return [self.arg]


@dataclass
class Extract(Node):
    part: str
    arg: Node

    def children(self):
        return [self.arg]


@dataclass
class Sub(Node):
    """A subquery as a value, in EXISTS or behind IN."""

    select: Select
    exists: bool = False


@dataclass
class In(Node):
    arg: Node
    items: list[Node]
    negated: bool

    def children(self):
        return [self.arg, *self.items]


@dataclass
class Projection:
    expr: Node
    alias: str | None


@dataclass
class Source:
    parts: list[str]
    alias: str | None
    columns: bool = False  # an alias list for the columns
    select: Select | None = None
    function: bool = False
    joined: str = ""  # how it is joined to what stands before
    natural: bool = False
    on: Node | None = None
    using: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.alias or self.parts[-1]


@dataclass
class Select:
    ctes: list[tuple[str, Select, bool]] = field(default_factory=list)
    recursive: bool = False
    distinct: bool = False
    projections: list[Projection] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    order: list[tuple[Node, str]] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None
    limit_form: str = ""  # percent, ties
    lock: bool = False
    set_operation: bool = False
    into: bool = False


# --- the parser --------------------------------------------------------------------------------

#: The parts that may be extracted from a date or time.
EXTRACTED = {"year", "month", "day", "hour", "minute", "second", "quarter", "week", "doy", "dow", "isodow", "dayofweek", "dayofweek_iso"}
_DML = {"INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "COPY", "CALL", "DO", "SET", "VACUUM", "ANALYZE", "EXPLAIN", "LOCK", "COMMENT", "BEGIN", "COMMIT", "ROLLBACK", "VALUES", "TABLE", "SHOW"}
_RESERVED = {"SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "FOR", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "OUTER", "AND", "OR", "NOT", "AS", "IN", "IS", "LIKE", "ILIKE", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE", "END", "INTO", "WITH", "DISTINCT", "ASC", "DESC", "NULLS", "SEMI", "ANTI", "WINDOW", "SIMILAR"}


class Parser:
    """``rendered`` adds the two operators that only the renderer writes."""

    def __init__(self, tokens: list[Token], rendered: bool = False):
        self.tokens, self.at, self.rendered = [*tokens, Token("end", "")], 0, rendered

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def fail(self):
        raise Rejected("parse_error", f"at {self.now.text!r}")

    def sees(self, *words: str) -> bool:
        return all(self.at + i < len(self.tokens) and (self.tokens[self.at + i].word() == w or self.tokens[self.at + i].kind == "op" and self.tokens[self.at + i].text == w) for i, w in enumerate(words))

    def skip(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.skip(*words):
            self.fail()

    def identifier(self) -> str:
        t = self.take()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        if t.kind == "word" and t.word() not in _RESERVED:
            return t.text.lower()
        self.at -= 1
        return self.fail()

    def statement(self) -> Select:
        s = self.query(top=True)
        if self.now.kind != "end":
            self.fail()
        return s

    def query(self, top: bool = False) -> Select:
        ctes, recursive = [], False
        if self.skip("WITH"):
            recursive = self.skip("RECURSIVE")
            while True:
                name = self.identifier()
                listed = False
                if self.skip("("):
                    listed = True
                    while not self.skip(")"):
                        self.take() if self.now.kind != "end" else self.fail()
                self.need("AS")
                self.skip("NOT", "MATERIALIZED") or self.skip("MATERIALIZED")
                self.need("(")
                ctes.append((name, self.query(), listed))
                self.need(")")
                if not self.skip(","):
                    break
        if self.now.word() in _DML and not self.sees("VALUES"):
            raise Rejected("not_select" if top and not ctes else "forbidden_statement", self.now.text)
        if self.sees("(") and top:
            self.need("(")
            s = self.query()
            self.need(")")
        else:
            s = self.select()
        while self.now.word() in ("UNION", "INTERSECT", "EXCEPT"):
            self.take()
            self.skip("ALL") or self.skip("DISTINCT")
            if self.skip("("):
                self.query()
                self.need(")")
            else:
                self.select()
            s.set_operation = True
        self.tail(s)
        s.ctes, s.recursive = ctes, recursive
        return s

    def select(self) -> Select:
        self.need("SELECT")
        s = Select()
        s.distinct = self.skip("DISTINCT")
        self.skip("ALL")
        while True:
            s.projections.append(self.projection())
            if not self.skip(","):
                break
        if self.skip("INTO"):
            s.into = True
            self.skip("TEMP") or self.skip("TEMPORARY")
            self.skip("TABLE")
            self.identifier()
        if self.skip("FROM"):
            self.sources(s)
        if self.skip("WHERE"):
            s.where = self.expr()
        if self.skip("GROUP", "BY"):
            while True:
                s.group.append(self.expr())
                if not self.skip(","):
                    break
        if self.skip("HAVING"):
            s.having = self.expr()
        return s

    def tail(self, s: Select) -> None:
        if self.skip("ORDER", "BY"):
            while True:
                e = self.expr()
                how = "DESC" if self.skip("DESC") else "ASC" if self.skip("ASC") else ""
                if self.skip("NULLS"):
                    how += " NULLS " + ("FIRST" if self.skip("FIRST") else "LAST" if self.skip("LAST") else self.fail())
                s.order.append((e, how or "ASC"))
                if not self.skip(","):
                    break
        while True:
            if self.skip("LIMIT"):
                s.limit = Name(["all"]) if self.skip("ALL") else self.expr()
            elif self.skip("OFFSET"):
                s.offset = self.expr()
                self.skip("ROWS") or self.skip("ROW")
            elif self.skip("FETCH"):
                self.skip("FIRST") or self.need("NEXT")
                s.limit = Literal("1", 1) if self.now.word() in ("ROW", "ROWS") else self.primary()
                if self.skip("PERCENT"):
                    s.limit_form = "percent"
                self.skip("ROWS") or self.skip("ROW")
                if self.skip("WITH", "TIES"):
                    s.limit_form = "ties"
                else:
                    self.need("ONLY")
            elif self.skip("FOR"):
                self.skip("NO", "KEY") or self.skip("KEY")
                self.skip("UPDATE") or self.need("SHARE")
                s.lock = True
                if self.skip("OF"):
                    self.identifier()
                self.skip("NOWAIT") or self.skip("SKIP", "LOCKED")
            else:
                return

    def projection(self) -> Projection:
        if self.skip("*"):
            return Projection(Star(), None)
        e = self.expr()
        if self.skip("AS"):
            return Projection(e, self.label())
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.word() not in _RESERVED:
            return Projection(e, self.identifier())
        return Projection(e, None)

    def label(self) -> str:
        t = self.take()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        if t.kind == "word":
            return t.text.lower()
        self.at -= 1
        return self.fail()

    def source(self) -> Source:
        self.skip("LATERAL")
        if self.skip("("):
            if self.now.word() in _DML and not self.sees("VALUES"):
                raise Rejected("forbidden_statement", self.now.text)
            src = Source([], None, select=self.query())
            self.need(")")
        else:
            parts = [self.identifier()]
            while self.skip("."):
                parts.append(self.identifier())
            src = Source(parts, None)
            if self.sees("("):
                src.function = True
                depth = 0
                while True:
                    t = self.take()
                    depth += (t.text == "(") - (t.text == ")")
                    if t.kind == "end":
                        self.fail()
                    if not depth:
                        break
        if self.skip("AS") or self.now.kind == "quoted" or self.now.kind == "word" and self.now.word() not in _RESERVED:
            src.alias = self.identifier()
            if self.sees("("):
                src.columns = True
                while not self.skip(")"):
                    self.take() if self.now.kind != "end" else self.fail()
        if src.select is not None and not src.alias:
            self.fail()
        return src

    def sources(self, s: Select) -> None:
        s.sources.append(self.source())
        while True:
            if self.skip(","):
                nxt = self.source()
                nxt.joined = "CROSS"
                s.sources.append(nxt)
                continue
            natural = self.skip("NATURAL")
            side = ""
            for w in ("INNER", "CROSS", "LEFT", "RIGHT", "FULL", "SEMI", "ANTI"):
                if self.skip(w):
                    side = w
                    break
            if side in ("LEFT", "RIGHT", "FULL"):
                self.skip("OUTER") or self.skip("SEMI") or self.skip("ANTI")
            if not self.skip("JOIN"):
                if natural or side:
                    self.fail()
                return
            nxt = self.source()
            nxt.joined, nxt.natural = side or "INNER", natural
            if self.skip("ON"):
                nxt.on = self.expr()
            elif self.skip("USING"):
                self.need("(")
                nxt.using = [self.identifier()]
                while self.skip(","):
                    nxt.using.append(self.identifier())
                self.need(")")
            s.sources.append(nxt)

    # Expressions, by rising strength of their operators.
    def expr(self) -> Node:
        e = self.conjunction()
        while self.skip("OR"):
            e = Op("OR", [e, self.conjunction()])
        return e

    def conjunction(self) -> Node:
        e = self.negation()
        while self.skip("AND"):
            e = Op("AND", [e, self.negation()])
        return e

    def negation(self) -> Node:
        return Op("NOT", [self.negation()]) if self.skip("NOT") else self.comparison()

    def comparison(self) -> Node:
        e = self.sum()
        while True:
            for op in ("=", "<>", "!=", "<=", ">=", "<", ">", *(["<=>"] if self.rendered else [])):
                if self.now.kind == "op" and self.now.text == op:
                    self.take()
                    e = Op("<>" if op == "!=" else op, [e, self.sum()])
                    break
            else:
                if self.skip("IS"):
                    no = self.skip("NOT")
                    if self.skip("DISTINCT", "FROM"):
                        e = Op("<=>", [e, self.sum()])
                        e = e if no else Op("NOT", [e])
                        continue
                    word = self.take().word()
                    if word not in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                        self.fail()
                    e = Op(f"IS {'NOT ' if no else ''}{'NULL' if word == 'UNKNOWN' else word}", [e])
                    continue
                no = self.sees("NOT") and (self.tokens[self.at + 1].word() in ("IN", "LIKE", "ILIKE", "BETWEEN"))
                if no:
                    self.take()
                if self.skip("IN"):
                    self.need("(")
                    if self.now.word() in ("SELECT", "WITH"):
                        items: list[Node] = [Sub(self.query())]
                    else:
                        items = [self.expr()]
                        while self.skip(","):
                            items.append(self.expr())
                    self.need(")")
                    e = In(e, items, no)
                elif self.sees("LIKE") or self.sees("ILIKE"):
                    op = self.take().word()
                    e = Op(op, [e, self.sum()])
                    e = Op("NOT", [e]) if no else e
                elif self.skip("BETWEEN"):
                    low = self.sum()
                    self.need("AND")
                    e = Op("BETWEEN", [e, low, self.sum()])
                    e = Op("NOT", [e]) if no else e
                else:
                    return e

    def sum(self) -> Node:
        e = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            e = Op(self.take().text, [e, self.product()])
        return e

    def product(self) -> Node:
        e = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            e = Op(self.take().text, [e, self.unary()])
        while self.rendered and self.skip("DIV"):
            e = Op("DIV", [e, self.unary()])
        return e

    def unary(self) -> Node:
        if self.now.kind == "op" and self.now.text in ("-", "+"):
            return Op("sign" + self.take().text, [self.unary()])
        e = self.primary()
        while self.skip("::"):
            e = Cast(e, self.type_name())
        return e

    def type_name(self) -> str:
        words = [self.take().text.lower()]
        while self.now.word() in ("PRECISION", "VARYING", "WITH", "WITHOUT", "TIME", "ZONE"):
            words.append(self.take().text.lower())
        if self.skip("("):
            inner = ""
            while not self.skip(")"):
                inner += self.take().text if self.now.kind != "end" else self.fail()
            words.append(f"({inner})")
        return " ".join(words)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "number":
            self.take()
            return Literal(t.text, int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "string":
            self.take()
            v = _string(t.text)
            return Literal(_quote(v), v)
        if self.skip("("):
            if self.now.word() in ("SELECT", "WITH"):
                e: Node = Sub(self.query())
            else:
                e = self.expr()
                if self.sees(","):
                    self.fail()
                e = Op("()", [e])
            self.need(")")
            return e
        if t.kind == "word":
            w = t.word()
            if w in ("NULL", "TRUE", "FALSE"):
                self.take()
                return Literal(w, {"NULL": None, "TRUE": True, "FALSE": False}[w])
            if w == "CASE":
                return self.case()
            if w == "EXISTS" and self.tokens[self.at + 1].text == "(":
                self.take(), self.take()
                s = self.query()
                self.need(")")
                return Sub(s, exists=True)
            if w == "CAST" and self.tokens[self.at + 1].text == "(":
                self.take(), self.take()
                e = self.expr()
                self.need("AS")
                kind = self.type_name()
                self.need(")")
                return Cast(e, kind)
            if w == "EXTRACT" and self.tokens[self.at + 1].text == "(":
                self.take(), self.take()
                t = self.take()
                part = (_string(t.text) if t.kind == "string" else t.text).lower()
                if t.kind not in ("word", "string") or part not in EXTRACTED:
                    raise Rejected("parse_error", f"extract {t.text!r}")
                self.need("FROM")
                e = self.expr()
                self.need(")")
                return Extract(part, e)
            if w == "INTERVAL" and self.tokens[self.at + 1].kind == "string":
                self.take()
                v = _string(self.take().text)
                return Literal(f"INTERVAL {_quote(v)}", v)
            if w in ("DATE", "TIMESTAMP") and self.tokens[self.at + 1].kind == "string":
                self.take()
                v = _string(self.take().text)
                return Literal(f"{w} {_quote(v)}", v)
            if w in ("CURRENT_DATE", "CURRENT_TIMESTAMP", "LOCALTIMESTAMP", "CURRENT_USER", "SESSION_USER"):
                self.take()
                return Call(w.lower(), [])
        if t.kind not in ("word", "quoted"):
            self.fail()
        parts = [self.identifier()]
        while self.sees("."):
            self.take()
            if self.skip("*"):
                return Star(parts[-1])
            parts.append(self.label())
        if self.skip("("):
            return self.call(parts[-1] if len(parts) == 1 else ".".join(parts))
        return Name(parts)

    def call(self, name: str) -> Node:
        if self.skip("*"):
            self.need(")")
            return Call(name, [], star=True)
        c = Call(name, [])
        if self.skip(")"):
            return c
        c.distinct = self.skip("DISTINCT")
        if name == "trim" and self.now.word() in ("BOTH", "LEADING", "TRAILING"):
            self.take()
            self.skip("FROM")
        c.args.append(self.expr())
        while self.skip(",") or name in ("substring", "trim") and (self.skip("FROM") or self.skip("FOR")):
            c.args.append(self.expr())
        self.need(")")
        if self.sees("OVER") or self.sees("FILTER"):
            self.fail()
        return c

    def case(self) -> Node:
        self.need("CASE")
        subject = None if self.sees("WHEN") else self.expr()
        whens = []
        while self.skip("WHEN"):
            a = self.expr()
            self.need("THEN")
            whens.append((a, self.expr()))
        default = self.expr() if self.skip("ELSE") else None
        self.need("END")
        if not whens:
            self.fail()
        return Case(subject, whens, default)


def _string(text: str) -> str:
    if text[0] == "$":
        tag = text[: text.index("$", 1) + 1]
        return text[len(tag) : -len(tag)]
    head, body = text.split("'", 1)
    body = body[:-1].replace("''", "'")
    if head in ("e", "E"):
        body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), body)
    return body


def _quote(v: str) -> str:
    """A literal of Spark: quotes, backslashes and everything that isn't a plain character are escaped."""
    return "'" + re.sub(r"[\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff'\\]", lambda m: "\\" + m.group() if m.group() in "'\\" else f"\\u{ord(m.group()):04x}", v) + "'"


def _unquote(text: str) -> str:
    return re.sub(r"\\(u[0-9a-f]{4}|.)", lambda m: chr(int(m.group(1)[1:], 16)) if len(m.group(1)) == 5 else m.group(1), text[1:-1], flags=re.DOTALL)
