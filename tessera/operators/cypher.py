"""A read-only subset of Cypher over an edge list, compiled to DataFrame operations.

    [AS OF 'time'] MATCH (a[:Label])-[r[:TYPE]]->(b[:Label]) [WHERE test]
    [WITH [DISTINCT] item [AS name], ... [ORDER BY name [DESC]] [LIMIT n] [WHERE test]] ...
    RETURN [DISTINCT] item [AS name], ... [ORDER BY name [DESC]] [LIMIT n]

A WITH ends the scope: what follows sees its items only, by their names, and nodes that it
passes on. Where an item of a WITH counts, its other items are what it counts by, and a
WHERE behind it filters the groups; in RETURN a count stands alone. A test joins comparisons (= <> < <= > >= CONTAINS, STARTS WITH) and label tests
with NOT, AND, OR and brackets. Items are a.name, a.type, r.predicate, r.source,
r.from, r.to, literals, toInteger(item), labels(a), count(*) and
count(DISTINCT item), and names that a WITH gave. A comparison that cannot be decided is false. Everything
else raises CypherError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn


class CypherError(ValueError):
    """The statement is not in the subset."""


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(-?\d+)|([A-Za-z_][A-Za-z0-9_]*)|(<=|>=|<>|->|<-|\.\.|[-()\[\]:,.*=<>|]))")
_WRITES = ("create", "merge", "delete", "remove", "set", "detach", "drop")


@dataclass
class Stage:
    """A WITH or RETURN: items (name, column, whether it counts), and what is done to their rows."""

    items: list[tuple[str, Column, bool]] = field(default_factory=list)
    distinct: bool = False
    order: tuple[str, bool] | None = None
    limit: int | None = None
    where: Column | None = None


@dataclass
class Statement:
    left: tuple[str, str | None]
    edge: tuple[str | None, str | None]
    right: tuple[str, str | None]
    at: str | None = None
    where: Column | None = None
    stages: list[Stage] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"invalid text at {text[at:at + 20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.i = 0
        if any(t.lower() in _WRITES for t in self.tokens):
            raise CypherError("writes are unsupported")

    def peek(self, *words: str) -> bool:
        have = [t.lower() for t in self.tokens[self.i : self.i + len(words)]]
        return have == [w.lower() for w in words]

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise CypherError(f"expected {' '.join(words)} at {' '.join(self.tokens[self.i:self.i + 3])!r}")

    def name(self) -> str:
        if self.i < len(self.tokens) and re.fullmatch(r"[A-Za-z_]\w*", self.tokens[self.i]):
            self.i += 1
            return self.tokens[self.i - 1]
        raise CypherError(f"a name was expected at {' '.join(self.tokens[self.i:self.i + 3])!r}")

    def node(self) -> tuple[str, str | None]:
        self.need("(")
        var = self.name()
        label = self.name() if self.take(":") else None
        self.need(")")
        return var, label

    def statement(self) -> Statement:
        at = None
        if self.take("as", "of"):
            at = self.literal()
        self.need("match")
        left = self.node()
        if self.take("<-"):
            raise CypherError("reverse patterns are unsupported")
        self.need("-")
        self.need("[")
        var = self.name() if not self.peek(":") and not self.peek("]") else None
        kind = self.name() if self.take(":") else None
        if self.peek("|") or self.peek("*"):
            raise CypherError("alternation and variable length are unsupported")
        self.need("]")
        self.need("->")
        s = Statement(left, (var, kind), self.node(), at)
        if s.left[0] == s.right[0]:
            raise CypherError("the two nodes need different names")
        #: What a name stands for: a node (by its name), the edge, or a value.
        self.scope: dict[str, tuple[str, Column | None]] = {left[0]: ("node", F.col("src")), s.right[0]: ("node", F.col("dst"))}
        if var:
            self.scope[var] = ("edge", None)
        if self.take("where"):
            s.where = self.either()
        while self.take("with"):
            s.stages.append(self.stage(last=False))
        self.need("return")
        s.stages.append(self.stage(last=True))
        if self.i < len(self.tokens):
            raise CypherError("text after the statement")
        return s

    def stage(self, last: bool) -> Stage:
        st = Stage(distinct=self.take("distinct"))
        seen: dict[str, tuple[str, Column | None]] = {}
        while True:
            name, column, counts, kind = self.item(last)
            if name in seen:
                raise CypherError(f"two items are named {name}")
            st.items.append((name, column, counts))
            seen[name] = (kind, F.col(f"`{name}`"))
            if not self.take(","):
                break
        if last and len(st.items) > 1 and any(x[2] for x in st.items):
            raise CypherError("count stands alone in RETURN; a WITH counts by groups")
        if self.take("order", "by"):
            st.order = (self.name(), self.take("desc"))
            if st.order[0] not in seen:
                raise CypherError("ORDER BY takes a returned name")
        if self.take("limit"):
            if self.i >= len(self.tokens) or not self.tokens[self.i].isdigit():
                raise CypherError("LIMIT takes a whole number")
            st.limit = int(self.tokens[self.i])
            self.i += 1
        if not last:
            self.scope = seen
            if self.take("where"):
                st.where = self.either()
        return st

    def literal(self) -> str:
        t = self.tokens[self.i] if self.i < len(self.tokens) else ""
        if not t.startswith("'"):
            raise CypherError("a string was expected")
        self.i += 1
        return re.sub(r"\\(.)", r"\1", t[1:-1])

    def value(self) -> tuple[str, Column]:
        """Default name and column of an item."""
        if self.i >= len(self.tokens):
            raise CypherError("an item was expected")
        t = self.tokens[self.i]
        if t.startswith("'"):
            x = self.literal()
            return x, F.lit(x)
        if re.fullmatch(r"-?\d+", t):
            self.i += 1
            return t, F.lit(int(t))
        var = self.name()
        if var.lower() == "tointeger" and self.take("("):
            n, c = self.value()
            self.need(")")
            return f"toInteger({n})", F.trim(c.cast("string")).try_cast("bigint")
        if var.lower() == "labels" and self.take("("):
            v = self.name()
            self.need(")")
            return f"labels({v})", F.array(F.initcap(fn.entity_type(self.end(v))))
        if self.scope.get(var, ("", None))[0] == "value":
            return var, self.scope[var][1]
        self.need(".")
        prop = self.name()
        return f"{var}.{prop}", self.prop(var, prop)

    def end(self, var: str) -> Column:
        if self.scope.get(var, ("", None))[0] == "node":
            return self.scope[var][1]
        raise CypherError(f"{var} is no node here")

    def prop(self, var: str, prop: str) -> Column:
        if self.scope.get(var, ("", None))[0] == "edge":
            cols = {"predicate": "predicate", "type": "predicate", "source": "source", "from": "src", "to": "dst"}
            if prop not in cols:
                raise CypherError(f"an edge has no {prop}")
            return F.col(cols[prop])
        if prop == "name":
            return self.end(var)
        if prop in ("type", "kind"):
            return fn.entity_type(self.end(var))
        raise CypherError(f"a node has no {prop}")

    def item(self, last: bool) -> tuple[str, Column, bool, str]:
        if self.take("count", "("):
            if self.take("*"):
                name, column = "count(*)", F.count("*")
            else:
                self.need("distinct")
                n, c = self.value()
                name, column = f"count(DISTINCT {n})", F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit("null")))
            self.need(")")
            return (self.name() if self.take("as") else name), column, True, "value"
        word = self.tokens[self.i] if self.i < len(self.tokens) else ""
        following = self.tokens[self.i + 1] if self.i + 1 < len(self.tokens) else ""
        if self.scope.get(word, ("", None))[0] == "node" and following != ".":
            if last:
                raise CypherError("a node is returned by its properties")
            self.i += 1
            return (self.name() if self.take("as") else word), self.end(word), False, "node"
        n, c = self.value()
        name = self.name() if self.take("as") else n
        if not last and name == n and not re.fullmatch(r"[A-Za-z_]\w*", n):
            raise CypherError("WITH needs a name for an expression")
        return name, c, False, "value"

    def either(self) -> Column:
        c = self.all()
        while self.take("or"):
            c = c | self.all()
        return c

    def all(self) -> Column:
        c = self.one()
        while self.take("and"):
            c = c & self.one()
        return c

    def one(self) -> Column:
        if self.take("not"):
            return ~self.one()
        if self.take("("):
            c = self.either()
            self.need(")")
            return c
        if self.i + 1 < len(self.tokens) and self.tokens[self.i + 1] == ":":
            node = self.end(self.name())
            self.need(":")
            return F.coalesce(fn.entity_type(node) == self.name().lower(), F.lit(False))
        _, a = self.value()
        if self.take("contains"):
            test = F.contains(a, self.value()[1])
        elif self.take("starts", "with"):
            test = F.startswith(a, self.value()[1])
        else:
            sign = self.tokens[self.i] if self.i < len(self.tokens) else ""
            if sign not in ("=", "<>", "<", "<=", ">", ">="):
                raise CypherError("a comparison was expected")
            self.i += 1
            _, b = self.value()
            # as numbers where both sides are whole numbers, else as text
            pick = lambda x, y: {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
            x, y = a.cast("string").try_cast("bigint"), b.cast("string").try_cast("bigint")
            test = F.when(x.isNotNull() & y.isNotNull(), pick(x, y)).otherwise(pick(a.cast("string"), b.cast("string")))
        return F.coalesce(test, F.lit(False))


def query(edges: DataFrame, text: str, *, at: str | None = None) -> DataFrame:
    """Run a statement over ``edges`` (src, predicate, dst, source; with valid_from and
    valid_until if the statement or ``at`` names a time). Types, labels and tests become
    filters on the scan, which Catalyst pushes down."""
    s = _Parser(text).statement()
    rows, when = edges, s.at or at
    if when is not None:
        t = F.to_timestamp(F.lit(when))
        rows = rows.where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))
    if s.edge[1]:
        rows = rows.where(F.col("predicate") == s.edge[1])
    for column, label in (("src", s.left[1]), ("dst", s.right[1])):
        if label:
            rows = rows.where(fn.entity_type(F.col(column)) == label.lower())
    if s.where is not None:
        rows = rows.where(s.where)
    for st in s.stages:
        rows = _apply(rows, st)
    return rows


def _apply(rows: DataFrame, st: Stage) -> DataFrame:
    plain = [c.alias(n) for n, c, counts in st.items if not counts]
    counted = [c.alias(n) for n, c, counts in st.items if counts]
    if counted:
        rows = (rows.groupBy(*plain) if plain else rows).agg(*counted).select(*[F.col(f"`{n}`") for n, _, _ in st.items])
    else:
        rows = rows.select(*plain)
    rows = rows.distinct() if st.distinct else rows
    if st.order:
        key = F.col(f"`{st.order[0]}`")
        rest = [F.col(f"`{n}`") for n, _, _ in st.items if n != st.order[0]]
        rows = rows.orderBy(key.desc() if st.order[1] else key, *rest)
    rows = rows.limit(st.limit) if st.limit is not None else rows
    return rows if st.where is None else rows.where(st.where)


def query_page(edges: DataFrame, text: str, max_rows: int = 100, *, at: str | None = None) -> tuple[DataFrame, bool]:
    """At most ``max_rows`` rows of query() (1 to 500), and whether more were left out: one row
    beyond the page is looked for, never all."""
    most = max(1, min(500, max_rows))
    rows = query(edges, text, at=at)
    return rows.limit(most), len(rows.offset(most).limit(1).take(1)) > 0
