"""Compiles a parsed query to DataFrame operations over triples (s, p, o).

A binding is a row with a nullable text column for each variable; null is unbound. Variables that every row binds
join by plain equality, so Catalyst can hash or broadcast; only variables that may be unbound need a condition
that tolerates nulls. An expression is a tagged value whose parts are Columns; tags of constants fold away.

Two dialects: "compat" keeps the order of clauses as written, compares computed values as text, and applies
DISTINCT, OFFSET and LIMIT before the projection; "w3c" filters whole groups, computes projections everywhere and
applies them after it. Text order is by code points. MIN and MAX leave unbound values out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.plans.sparql.syntax import RDF_TYPE, Query, parse
from veldspar.shared import written

PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


@dataclass(frozen=True)
class Value:
    """tag: s text, i whole number, d number, b truth, u unbound; the parts that the tag doesn't name are unused."""

    tag: Column
    text: Column
    whole: Column
    number: Column

    @property
    def is_number(self) -> Column:
        return self.tag.isin("i", "d")

    @property
    def numeric(self) -> Column:
        return F.when(self.is_number, self.number).when(self.tag == "s", V.number_of_text(self.text)).when(self.tag == "b", F.when(self.text == "true", 1.0).otherwise(0.0))

    @property
    def truth(self) -> Column:
        return F.when(self.tag == "b", self.text == "true").when(self.is_number, self.number != 0).when(self.tag == "s", self.text != "").otherwise(False)

    @property
    def plain(self) -> Column:
        return unquoted(self.text)


def _nulls() -> tuple[Column, Column]:
    return F.lit(None).cast("bigint"), F.lit(None).cast("double")


def text_value(text: Column) -> Value:
    return Value(F.lit("s"), text, *_nulls())


def truth_value(b: Column) -> Value:
    return Value(F.lit("b"), F.when(b, "true").otherwise("false"), *_nulls())


def whole_value(i: Column) -> Value:
    return Value(F.lit("i"), i.cast("string"), i.cast("bigint"), i.cast("double"))


def number_value(d: Column) -> Value:
    return Value(F.lit("d"), V.number_text(d), F.lit(None).cast("bigint"), d.cast("double"))


def unquoted(raw: Column) -> Column:
    """Literals without their quotes, type and language; other text as it is."""
    whole = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
    return F.when(whole, raw.substr(F.lit(2), F.length(raw) - 2)).when(raw.rlike('^"[^"]*"'), F.regexp_extract(raw, '^"([^"]*)"', 1)).otherwise(raw)


def stored_value(raw: Column) -> Value:
    """A bound term: quoted numbers are numbers, other literals keep their quotes, null is unbound."""
    inner = F.regexp_extract(raw, '^"([^"]*)"', 1)
    quoted = raw.rlike('^"[^"]*"')
    whole = F.when(quoted & inner.rlike("^[+-]?[0-9]+$"), inner.try_cast("bigint"))
    number = F.when(quoted, V.number_of_text(inner))
    tag = F.when(raw.isNull(), "u").when(whole.isNotNull(), "i").when(number.isNotNull(), "d").otherwise("s")
    text = F.when(raw.isNull(), "").when(whole.isNotNull(), whole.cast("string")).when(number.isNotNull(), V.number_text(number)).otherwise(raw)
    return Value(tag, text, whole, F.coalesce(whole.cast("double"), number))


def equal(a: Value, b: Value) -> Column:
    return F.when(a.is_number & b.is_number, a.number == b.number).otherwise(a.text == b.text)


def less(a: Value, b: Value) -> Column:
    return F.when(a.is_number & b.is_number, a.number < b.number).otherwise(a.text < b.text)


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    whole, numbers = (a.tag == "i") & (b.tag == "i"), a.is_number & b.is_number
    if op == "+":
        i, d = a.whole + b.whole, a.number + b.number
        other_tag, other_text, other = "s", F.concat(a.text, b.text), F.lit(None).cast("double")
    else:
        i, d = (a.whole - b.whole, a.number - b.number) if op == "-" else (a.whole * b.whole, a.number * b.number)
        other_tag, other_text, other = "d", F.lit("0"), F.lit(0.0)
    i = F.when(whole, i)
    d = F.when(whole, i.cast("double")).when(numbers, d).otherwise(other)
    return Value(F.when(whole, "i").when(numbers, "d").otherwise(other_tag), F.when(whole, i.cast("string")).when(numbers, V.number_text(d)).otherwise(other_text), i, d)


class _Compiler:
    def __init__(self, triples: DataFrame, query: Query, dialect: str):
        self.triples, self.query, self.w3c = triples, query, dialect == "w3c"
        self.prefixes = {**PREFIXES, **query.prefixes}

    # -- terms

    def constant(self, term: tuple) -> str | None:
        """The stored form of a constant in a pattern."""
        kind = term[0]
        if kind == "iri":
            return term[1]
        if kind == "name":
            return self.prefixes[term[1]] + term[2] if term[1] in self.prefixes else f"{term[1]}:{term[2]}"
        if kind == "text":
            if term[2] is not None and not self.w3c:
                return f'"{term[1]}"^^<{self.constant(term[2])}>'
            return f'"{term[1]}"@{term[3]}' if term[3] and not self.w3c else f'"{term[1]}"'
        return f'"{term[1]}"'

    def matches(self, column: Column, term: tuple) -> Column:
        text = self.constant(term)
        if self.w3c and text == RDF_TYPE:
            return column.isin(RDF_TYPE, "rdf:type")
        if self.w3c and text == PREFIXES["rdfs"] + "label":
            return column.isin(text, "rdfs:label")
        return column == text

    # -- patterns: (rows, variables that every row binds)

    def triple(self, pattern: tuple) -> tuple[DataFrame, set[str]]:
        conditions, columns = [], {}
        for part, term in zip("spo", pattern, strict=True):
            if term[0] != "var":
                conditions.append(self.matches(F.col(part), term))
            elif term[1] in columns:
                conditions.append(F.col(part) == F.col(columns[term[1]]))
            else:
                columns[term[1]] = part
        rows = self.triples
        for c in conditions:
            rows = rows.where(c)
        return rows.select(*[F.col(part).alias(name) for name, part in columns.items()]), set(columns)

    def bgp(self, patterns: tuple) -> tuple[DataFrame, set[str]]:
        left = list(patterns)
        rows, bound = self.triple(left.pop(0))
        while left:  # the next that shares a variable, so that nothing is crossed that needn't be
            k = next((k for k, p in enumerate(left) if bound & {t[1] for t in p if t[0] == "var"}), 0)
            more, own = self.triple(left.pop(k))
            shared = sorted(bound & own)
            rows = rows.join(more, shared) if shared else rows.crossJoin(more)
            bound |= own
        return rows, bound

    def agreeing(self, left: DataFrame, right: DataFrame, sure: list[str], unsure: list[str], apart: bool) -> DataFrame:
        """Pairs of left and right (columns __r_<name>) rows whose shared variables agree or are unbound. `sure` ones are
        bound on both sides. Where there are none, rows are split by whether the first unsure one is bound, so that those
        that bind it meet by its value and not by a nested loop; only unbound rows meet all others, unless `apart`:
        then some variable must be bound on both sides."""
        if sure or not unsure:
            return left.join(right, _agree(sure, unsure))
        v, rest = unsure[0], unsure[1:]
        mine, theirs = F.col(v).isNotNull(), F.col(f"__r_{v}").isNotNull()
        out = self.agreeing(left.where(mine), right.where(theirs), [v], rest, False)
        if apart and not rest:
            return out
        out = out.unionByName(self.agreeing(left.where(mine), right.where(~theirs), [], rest, apart))
        return out.unionByName(self.agreeing(left.where(~mine), right, [], rest, apart))

    def merged(self, left: DataFrame, right: DataFrame, lb: set[str], rb: set[str], how: str) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        sure = [c for c in shared if c in lb and c in rb]
        unsure = [c for c in shared if c not in sure]
        renamed = right.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns])
        out = [F.coalesce(c, f"__r_{c}").alias(c) if c in shared else F.col(c) for c in left.columns]
        out += [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in shared]
        if how == "inner":
            return self.agreeing(left, renamed, sure, unsure, False).select(*out)
        if sure or not unsure:
            return left.join(renamed, _agree(sure, unsure), "left").select(*out)
        numbered = written(left.withColumn("__row", F.monotonically_increasing_id()))
        met = self.agreeing(numbered, renamed, sure, unsure, False)
        slim = renamed.select(*[f"__r_{c}" for c in unsure]).distinct()  # a row meets some row if it meets some value: no need of all pairs
        some = self.agreeing(numbered.select("__row", *unsure), slim, [], unsure, False).select("__row").distinct()
        alone = numbered.join(some, "__row", "left_anti")
        return met.select(*out).unionByName(alone.select(*left.columns), allowMissingColumns=True)

    def pattern(self, p: tuple) -> tuple[DataFrame, set[str]]:
        kind = p[0]
        if kind == "bgp":
            if not p[1]:
                return self.triples.sparkSession.range(1).select(F.lit("").alias("__unit")), set()
            return self.bgp(p[1])
        if self.w3c and kind in ("join", "optional", "minus", "bind", "filter"):
            p = _filters_last(p)
            kind = p[0]
        if kind == "filter":
            rows, bound = self.pattern(p[1])
            return rows.where(self.value(p[2], rows).truth), bound
        if kind == "bind":
            rows, bound = self.pattern(p[1])
            typed = self.typed(rows, [p[3]])
            return typed.withColumn(p[2], self.value(p[3], typed).text).drop(*[c for c in typed.columns if c.startswith("__v_")]), bound | {p[2]}
        (left, lb), (right, rb) = self.pattern(p[1]), self.pattern(p[2])
        if kind == "join" and p[1] == ("bgp", ()):
            return right, rb
        if kind in ("join", "optional") and p[2] == ("bgp", ()):
            return left, lb
        if kind == "join":
            return self.merged(left, right, lb, rb, "inner"), lb | rb
        if kind == "optional":
            return self.merged(left, right, lb, rb, "left"), lb
        if kind == "union":
            return left.unionByName(right, allowMissingColumns=True), lb & rb
        # minus: drops rows that agree with a right row in all variables that both bind, one at least
        shared = [c for c in left.columns if c in right.columns and c != "__unit"]
        if not shared:
            return left, lb
        slim = right.select(*[F.col(c).alias(f"__r_{c}") for c in shared]).distinct()
        sure = [c for c in shared if c in lb and c in rb]
        if sure:
            return left.join(slim, _agree(sure, [c for c in shared if c not in sure]), "left_anti"), lb
        numbered = written(left.withColumn("__row", F.monotonically_increasing_id()))
        met = self.agreeing(numbered, slim, [], shared, True).select("__row").distinct()
        return numbered.join(met, "__row", "left_anti").drop("__row"), lb

    # -- expressions

    def typed(self, rows: DataFrame, expressions: list) -> DataFrame:
        """Rows with a struct for the typed value of each variable of the expressions, so that it is worked out once."""
        names = [n for n in dict.fromkeys(_variables(expressions)) if n in rows.columns]
        parts = {}
        for n in names:
            v = stored_value(F.col(n))
            parts[f"__v_{n}"] = F.struct(v.tag.alias("tag"), v.text.alias("text"), v.whole.alias("whole"), v.number.alias("number"))
        return rows.withColumns(parts) if parts else rows

    def value(self, e: tuple, rows: DataFrame, computed: dict[str, Value] | None = None) -> Value:
        kind = e[0]
        if kind == "var":
            if computed and e[1] in computed:
                return computed[e[1]]
            if f"__v_{e[1]}" in rows.columns:
                return Value(*[F.col(f"__v_{e[1]}.{x}") for x in ("tag", "text", "whole", "number")])
            return stored_value(F.col(e[1])) if e[1] in rows.columns else Value(F.lit("u"), F.lit(""), *_nulls())
        if kind in ("iri", "name"):
            return text_value(F.lit(self.constant(e)))
        if kind == "text":
            if e[2] is not None:
                return stored_value(F.lit(f'"{e[1]}"')) if V._number_of(e[1]) is not None else text_value(F.lit(e[1]))
            return text_value(F.lit(f'"{e[1]}"' if self.w3c else e[1]))
        if kind == "int":
            return whole_value(F.lit(e[1]).cast("bigint"))
        if kind == "double":
            return number_value(F.lit(e[1]))
        if kind == "BOUND":
            return truth_value(F.col(e[1]).isNotNull() if e[1] in rows.columns else F.lit(False))
        if kind == "agg":
            if computed and e in computed:
                return computed[e]
            return text_value(F.lit(""))
        a = self.value(e[1], rows, computed)
        if kind == "!":
            return truth_value(~a.truth)
        if kind == "ISIRI":
            return truth_value(~a.text.startswith('"'))
        if kind == "ISLITERAL":
            return truth_value(a.text.startswith('"'))
        if kind == "STR":
            plain = a.plain
            return text_value(F.concat(F.lit('"'), plain, F.lit('"')) if self.w3c else plain)
        if kind == "LANG":
            return text_value(F.when(a.text.contains('"@'), F.substring_index(a.text, '"@', -1)).otherwise(""))
        if kind == "REGEX":
            return truth_value(a.plain.rlike(("(?i)" if "i" in e[3] else "") + e[2]))
        b = self.value(e[2], rows, computed)
        if kind in ("+", "-", "*"):
            return _arithmetic(kind, a, b)
        if kind == "/":
            below = b.numeric
            bad = below.isNull() | (below == 0)
            if getattr(self, "lenient", False):
                value = F.when(bad, F.lit(None).cast("double")).otherwise(F.coalesce(a.numeric, F.lit(0.0)) / F.when(bad, 1.0).otherwise(below))
                made = number_value(value)
                return Value(F.when(bad, "u").otherwise("d"), F.when(bad, "").otherwise(made.text), made.whole, made.number)
            error = F.raise_error(F.lit("division by zero or by what is no number")).cast("double")
            return number_value(F.when(bad, error).otherwise(F.coalesce(a.numeric, F.lit(0.0)) / F.when(bad, 1.0).otherwise(below)))
        tests = {"=": lambda: equal(a, b), "!=": lambda: ~equal(a, b), "<": lambda: less(a, b), ">": lambda: less(b, a), "<=": lambda: equal(a, b) | less(a, b), ">=": lambda: equal(a, b) | less(b, a), "&&": lambda: a.truth & b.truth, "||": lambda: a.truth | b.truth}
        return truth_value(tests[kind]())

    # -- grouping

    def grouped(self, rows: DataFrame, keys: list) -> DataFrame:
        q = self.query
        variables = [c for c in rows.columns if c != "__unit"]
        rows = self.typed(rows, [*keys, *([e for e, _ in q.projection] if isinstance(q.projection, list) and not isinstance(q.projection[0], str) else []), q.having])
        texts = [self.value(k, rows).text.alias(f"__k{n}") for n, k in enumerate(keys)]
        first = F.min(F.struct(*[F.col(c) for c in variables])).alias("__first") if variables else F.min(F.lit(1)).alias("__first")
        if not isinstance(q.projection, list) or isinstance(q.projection[0], str):
            return rows.groupBy(*texts).agg(first).select("__first.*")
        aggregates = _aggregates([e for e, _ in q.projection] + ([q.having] if q.having and self.w3c else []))
        made, columns = {}, []
        for n, e in enumerate(aggregates):
            columns += self.aggregate(e, rows, variables, n)
            made[e] = n
        out = rows.groupBy(*texts).agg(first, *columns)
        flat = out.select("*", *([F.col(f"__first.{c}").alias(c) for c in variables] if variables else []))
        computed = {e: self.aggregated(e, n) for e, n in made.items()}
        kept = [c for c in {k[1] for k in keys} if c in variables]
        cells = {name: self.value(e, flat, computed).text for e, name in q.projection}
        hidden = self.value(q.having, flat, computed) if q.having and self.w3c else None
        if hidden is not None:
            flat = flat.withColumn("__having", hidden.truth)
        result = flat.select(*[F.col(c) for c in kept if c not in cells], *[c.alias(n) for n, c in cells.items()], *(["__having"] if hidden is not None else []))
        if hidden is not None:
            return result.where("__having").drop("__having")
        return result.where(self.value(q.having, result).truth) if q.having else result

    def aggregate(self, e: tuple, rows: DataFrame, variables: list[str], n: int) -> list[Column]:
        _, function, inner, distinct = e
        if inner is None:
            if distinct:
                return [F.count_distinct(F.struct(*[F.coalesce(c, F.lit("\0")) for c in variables])).alias(f"__a{n}")]
            return [F.count("*").alias(f"__a{n}")]
        v = self.value(inner, rows)
        if function == "COUNT":
            text = F.when(v.tag != "u", v.text)
            return [(F.count_distinct(text) if distinct else F.count(text)).alias(f"__a{n}")]
        if function in ("SUM", "AVG"):
            x = v.numeric
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda c: F.sum_distinct(c) / F.when(F.count_distinct(c) > 0, F.count_distinct(c))}[function, distinct]
            return [F.coalesce(f(x), F.lit(0.0)).alias(f"__a{n}")]
        pick, pick_by = (F.min, F.min_by) if function == "MIN" else (F.max, F.max_by)
        bound, text = v.tag != "u", F.when(v.tag != "u", v.text)
        return [
            F.bool_and(F.when(bound, v.is_number)).alias(f"__n{n}"),
            pick(F.when(bound, v.number)).alias(f"__a{n}"),
            pick_by(F.when(bound & v.is_number, v.text), F.when(bound, v.number)).alias(f"__t{n}"),
            pick(text).alias(f"__s{n}"),
        ]

    def aggregated(self, e: tuple, n: int) -> Value:
        function = e[1]
        if function == "COUNT":
            return whole_value(F.col(f"__a{n}"))
        if function in ("SUM", "AVG"):
            return number_value(F.col(f"__a{n}"))
        numbers = F.coalesce(F.col(f"__n{n}"), F.lit(False))
        tag = F.when(F.col(f"__s{n}").isNull(), "u").when(numbers, "d").otherwise("s")
        return Value(tag, F.coalesce(F.when(numbers, F.col(f"__t{n}")).otherwise(F.col(f"__s{n}")), F.lit("")), F.lit(None).cast("bigint"), F.col(f"__a{n}"))

    # -- the whole query

    def run(self) -> DataFrame:
        q = self.query
        rows, _ = self.pattern(q.where)
        computed = isinstance(q.projection, list) and not isinstance(q.projection[0], str)
        if q.group_by is not None or (computed and _aggregates([e for e, _ in q.projection])):
            rows = self.grouped(rows, q.group_by or [])
            grouped = True
        else:
            grouped = False
            if computed and self.w3c:
                rows = rows.select("*", *[self.value(e, rows).text.alias(n) for e, n in q.projection if e != ("var", n)])
        variables = [c for c in rows.columns if not c.startswith("__")]
        names = sorted(variables) if q.projection == "*" else [p if isinstance(p, str) else p[1] for p in q.projection]
        if q.distinct:
            if self.w3c:
                rows = rows.select(*[F.col(n) for n in names if n in variables])
                variables = [n for n in names if n in variables]
            rows = rows.dropDuplicates(variables) if variables else rows.limit(1)
        if q.order_by or q.limit is not None or q.offset:
            self.lenient = True
            keys = []
            for e, up in q.order_by:
                v = self.value(e, rows)
                rank = F.when(v.tag == "u", 0).when(v.is_number, 1).otherwise(2)
                keys += [c.asc() if up else c.desc() for c in (rank, v.number, v.text)]
            rows = rows.orderBy(*keys, *[F.col(c).asc_nulls_first() for c in sorted(variables)])
        if q.offset:
            rows = rows.offset(q.offset)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        del grouped
        return rows.select(*[F.coalesce(unquoted(F.col(n)), F.lit("")).alias(n) if n in variables else F.lit("").alias(n) for n in names])


def _agree(sure: list[str], unsure: list[str]) -> Column:
    """Equal where bound on both sides for sure; equal or unbound on one side else."""
    condition = F.lit(True)
    for c in sure:
        condition = condition & (F.col(c) == F.col(f"__r_{c}"))
    for c in unsure:
        condition = condition & (F.col(c).isNull() | F.col(f"__r_{c}").isNull() | (F.col(c) == F.col(f"__r_{c}")))
    return condition


def _filters_last(p: tuple) -> tuple:
    """A group's filters see all of its group."""
    filters, inner = [], p

    def strip(x: tuple) -> tuple:
        if x[0] == "filter":
            filters.append(x[2])
            return strip(x[1])
        if x[0] in ("join", "optional", "minus"):
            return (x[0], strip(x[1]), x[2])
        if x[0] == "bind":
            return (x[0], strip(x[1]), *x[2:])
        return x

    inner = strip(inner)
    for e in reversed(filters):
        inner = ("filter", inner, e)
    return inner if filters and inner[0] == "filter" else p


def _variables(e) -> list[str]:
    if isinstance(e, tuple) and len(e) == 2 and e[0] in ("var", "BOUND") and isinstance(e[1], str):
        return [e[1]]
    return [n for x in e for n in _variables(x)] if isinstance(e, (tuple, list)) else []


def _aggregates(expressions: list) -> list[tuple]:
    out: list[tuple] = []

    def walk(e) -> None:
        if isinstance(e, tuple) and e:
            if e[0] == "agg":
                if e not in out:
                    out.append(e)
                return
            for x in e[1:]:
                walk(x)

    for e in expressions:
        walk(e)
    return out


def select(triples: DataFrame, text: str, dialect: str = "compat") -> DataFrame:
    """Runs a SELECT query over triples (s, p, o). Columns are the projected names; unbound is an empty text;
    literals come without quotes."""
    if dialect not in ("compat", "w3c"):
        raise ValueError(f"unknown dialect: {dialect}")
    return _Compiler(triples.select("s", "p", "o"), parse(text), dialect).run()


def to_tsv(result: DataFrame) -> DataFrame:
    """Rows as one text column with tabs between cells; the header is the column's name."""
    return result.select(F.concat_ws("\t", *[F.col(c) for c in result.columns]).alias("\t".join(result.columns)))
