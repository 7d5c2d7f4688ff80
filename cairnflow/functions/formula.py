"""A spreadsheet-like formula language, compiled to columns.

A formula becomes a pair of columns, value and error: the language stops on a null operand or a wrong type where
SQL would go on with null. Types are known when a formula is compiled, from the record's schema, so the result
is a plain expression that the optimiser sees through; nothing runs in Python.

    || OR   && AND   = == comparison (one a level)   + -   * /   unary - + !   Name, a.b.c, F(x, ...), literals
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FormulaError(ValueError):
    """The text is no formula, or its types do not fit."""


# --- text to tree -----------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<op>\|\||&&|<>|!=|<=|>=|[=<>+\-*/!(),.]))""",
    re.DOTALL,
)
#: Binding strength of the two-sided operators.
POWER = {"||": 1, "&&": 2, "=": 3, "<>": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5}
COMPARISONS = {op for op, power in POWER.items() if power == 3}


@dataclass(frozen=True)
class Node:
    """kind: literal, ref, call, unary or binary; value: the literal, the path, the name or the operator."""

    kind: str
    value: object
    args: tuple["Node", ...] = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


def parse(text: str) -> Node:
    """A formula's tree; raises FormulaError."""
    left = tokens(text)
    node, rest = _expression(left, 0)
    if rest[0][0] != "end":
        raise FormulaError(f"unexpected {rest[0][1]!r} after the formula")
    return node


def _expression(ts, least: int):
    node, ts = _operand(ts)
    while ts[0][0] == "op" and POWER.get(ts[0][1], 0) > least:
        op = ts[0][1]
        right, ts = _expression(ts[1:], POWER[op])
        node = Node("binary", op, (node, right))
        if op in COMPARISONS and ts[0][1] in COMPARISONS and ts[0][0] == "op":
            raise FormulaError("comparisons do not chain")
    return node, ts


def _operand(ts):
    (kind, value), rest = ts[0], ts[1:]
    if kind == "op" and value in "-+!":
        node, rest = _operand(rest)
        return (node if value == "+" else Node("unary", value, (node,))), rest
    if kind == "op" and value == "(":
        node, rest = _expression(rest, 0)
        return node, _expect(rest, ")")
    if kind == "number":
        number = float(value)
        return Node("literal", int(number) if number.is_integer() else number), rest
    if kind == "text":
        return Node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL)), rest
    if kind != "name":
        raise FormulaError(f"an operand is missing before {value!r}")
    if rest[0] == ("op", "("):
        return _call(value.upper(), rest[1:])
    if (word := value.upper()) in ("TRUE", "FALSE", "NULL"):
        return Node("literal", {"TRUE": True, "FALSE": False, "NULL": None}[word]), rest
    path = [value]
    while rest[0] == ("op", "."):
        if rest[1][0] != "name":
            raise FormulaError("a name is missing after '.'")
        path.append(rest[1][1])
        rest = rest[2:]
    return Node("ref", tuple(path)), rest


def _call(name: str, ts):
    if name not in FUNCTIONS:
        raise FormulaError(f"unknown function {name}")
    args = []
    if ts[0] == ("op", ")"):
        ts = ts[1:]
    else:
        while True:
            node, ts = _expression(ts, 0)
            args.append(node)
            if ts[0] != ("op", ","):
                ts = _expect(ts, ")")
                break
            ts = ts[1:]
    arity = FUNCTIONS[name][0]
    if not arity(len(args)):
        raise FormulaError(f"{name} does not take {len(args)} arguments")
    return Node("call", name, tuple(args)), ts


def _expect(ts, op: str):
    if ts[0] != ("op", op):
        raise FormulaError(f"{op!r} is missing before {ts[0][1]!r}")
    return ts[1:]


def references(node: Node) -> set[str]:
    """The fields that a formula reads, as dotted paths."""
    own = {".".join(node.value)} if node.kind == "ref" else set()
    return own.union(*map(references, node.args))


# --- tree to columns --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Typed:
    """A value of kind int, float, str, bool, date, time or null, and whether its evaluation fails."""

    kind: str
    value: Column
    error: Column


def _no() -> Column:
    return F.lit(False)


def _of(kind: str, value: Column, *parts: Typed, also: Column | None = None) -> Typed:
    errors = [p.error for p in parts] + ([] if also is None else [F.coalesce(also, F.lit(True))])
    error = reduce(lambda a, b: a | b, errors) if errors else _no()
    return Typed(kind, value, error)


KINDS = {T.StringType: "str", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "time", T.DoubleType: "float", T.FloatType: "float", T.DecimalType: "float"}


def _field(schema: T.StructType, path: tuple[str, ...], of: Callable[[str], Column]) -> Typed:
    """A dotted path: null where a segment is missing."""
    kind, column = schema, None
    for k, name in enumerate(path):
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return Typed("null", F.lit(None).cast("string"), _no())
        kind = kind[name].dataType
        column = of(name) if k == 0 else column[name]
    if isinstance(kind, T.IntegralType):
        return Typed("int", column.cast("long"), _no())
    name = KINDS.get(type(kind))
    if name is None:
        raise FormulaError(f"{'.'.join(path)} is no scalar")
    return Typed(name, column.cast("double") if name == "float" else column.cast("timestamp") if name == "time" else column, _no())


NUMBERS = ("int", "float", "bool")


def truthy(x: Typed) -> Column:
    """As the language sees it: null, 0, false and the empty text are false."""
    if x.kind == "null":
        return F.lit(False)
    if x.kind == "bool":
        return F.coalesce(x.value, F.lit(False))
    if x.kind in NUMBERS:
        return F.coalesce(x.value != 0, F.lit(False))
    if x.kind == "str":
        return F.coalesce(x.value != "", F.lit(False))
    return x.value.isNotNull()


def _number(x: Typed) -> Typed:
    return Typed("int", x.value.cast("long"), x.error) if x.kind == "bool" else x


def _float(x: Typed) -> Column:
    return _number(x).value.cast("double")


def _as(x: Typed, kind: str) -> Typed:
    """``x`` as a value of ``kind``, which must hold it."""
    if x.kind == kind:
        return x
    if x.kind == "null":
        return Typed(kind, F.lit(None).cast({"int": "long", "float": "double", "str": "string", "bool": "boolean", "date": "date", "time": "timestamp"}[kind]), x.error)
    if kind == "float" and x.kind in NUMBERS:
        return Typed(kind, _float(x), x.error)
    if kind == "int" and x.kind == "bool":
        return _number(x)
    raise FormulaError(f"a {x.kind} and a {kind} meet in one result")


def _common(xs: list[Typed]) -> list[Typed]:
    kinds = {x.kind for x in xs} - {"null"}
    if not kinds:
        return xs
    if len(kinds) > 1:
        if not kinds <= set(NUMBERS):
            raise FormulaError(f"results of kinds {sorted(kinds)} in one place")
        kinds = {"float"} if "float" in kinds else {"int"}
    kind = kinds.pop()
    return [_as(x, kind) for x in xs]


def equal(a: Typed, b: Typed) -> Column:
    """Null equals null; values of different types differ; true is 1."""
    if "null" in (a.kind, b.kind):
        return a.value.isNull() & b.value.isNull()
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return _number(a).value.eqNullSafe(_number(b).value)
    if a.kind != b.kind:
        return a.value.isNull() & b.value.isNull()
    return a.value.eqNullSafe(b.value)


def _text_or_empty(x: Typed) -> Column:
    """The text; empty for what is false."""
    return F.when(truthy(x), text_of(x).value).otherwise("")


def text_of(x: Typed) -> Typed:
    if x.kind == "null":
        return _of("str", F.lit(""), x)
    if x.kind == "float":
        whole = (x.value == F.floor(x.value)) & (F.abs(x.value) < 1e18)
        value = F.when(whole, x.value.cast("long").cast("string")).otherwise(x.value.cast("string"))
    else:
        value = x.value.cast("string")
    return _of("str", F.coalesce(value, F.lit("")), x)


def is_blank(x: Typed) -> Column:
    if x.kind == "null":
        return F.lit(True)
    if x.kind == "str":
        return F.coalesce(F.regexp_replace(x.value, r"^\s+|\s+$", "") == "", F.lit(True))
    return x.value.isNull()


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("&&", "||"):
        return _logic([a, b], op == "&&")
    if op == "=":
        return _of("bool", equal(a, b), a, b)
    if op in ("<>", "!="):
        return _of("bool", ~equal(a, b), a, b)
    missing = a.value.isNull() | b.value.isNull()
    both = a.kind in NUMBERS and b.kind in NUMBERS
    if op in COMPARISONS:
        if not both and (a.kind != b.kind or a.kind == "null"):
            return _of("bool", F.lit(None).cast("boolean"), a, b, also=F.lit(True))
        x, y = (_number(a).value, _number(b).value) if both else (a.value, b.value)
        value = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return _of("bool", value, a, b, also=missing)
    if op == "+" and a.kind == b.kind == "str":
        return _of("str", F.concat(a.value, b.value), a, b, also=missing)
    if op == "*" and {a.kind, b.kind} == {"str", "int"}:
        s, n = (a, b) if a.kind == "str" else (b, a)
        return _of("str", F.repeat(s.value, n.value.cast("int")), a, b, also=missing)
    if not both:
        return _of("float", F.lit(None).cast("double"), a, b, also=F.lit(True))
    if op == "/":
        return _of("float", F.try_divide(_float(a), _float(b)), a, b, also=missing | (_float(b) == 0))
    a, b = _number(a), _number(b)
    kind = "int" if a.kind == b.kind == "int" else "float"
    x, y = (a.value, b.value) if kind == "int" else (_float(a), _float(b))
    value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    return _of(kind, value, a, b, also=missing)


def _logic(xs: list[Typed], every: bool) -> Typed:
    """The deciding operand; operands behind it are not evaluated, so their errors do not count."""
    try:
        same = _common(xs)
    except FormulaError:  # operands of different kinds: only their truth is left
        same = [Typed("bool", truthy(x), x.error) for x in xs]
    result = same[-1]
    for x in reversed(same[:-1]):
        go_on = truthy(x) if every else ~truthy(x)
        result = Typed(x.kind if x.kind != "null" else result.kind, F.when(go_on, result.value).otherwise(x.value), x.error | (go_on & result.error))
    return result


def _if(cond: Typed, yes: Typed, no: Typed) -> Typed:
    yes, no = _common([yes, no])
    taken = truthy(cond)
    return Typed(yes.kind if yes.kind != "null" else no.kind, F.when(taken, yes.value).otherwise(no.value), cond.error | F.when(taken, yes.error).otherwise(no.error))


def _case(subject: Typed, *rest: Typed) -> Typed:
    results = _common([*rest[1::2], rest[-1]])
    out = results[-1]
    for value, result in reversed(list(zip(rest[:-1:2], results[:-1]))):
        hit = equal(subject, value)
        out = Typed(result.kind if result.kind != "null" else out.kind, F.when(hit, result.value).otherwise(out.value), value.error | F.when(hit, result.error).otherwise(out.error))
    return Typed(out.kind, out.value, subject.error | out.error)


def _int(x: Typed) -> Column:
    return _number(x).value.cast("int")


def _slice(s: Column, start: Column, stop: Column) -> Column:
    """Characters from start to stop, negative ones counted from the end."""
    n = F.length(s)
    place = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    return F.when(place(stop) <= place(start), "").otherwise(F.substring(s, place(start) + 1, place(stop) - place(start)))


def _left(s: Typed, n: Typed) -> Typed:
    return _of("str", _slice(_text_or_empty(s), F.lit(0), _int(n)), s, n, also=n.value.isNull())


def _right(s: Typed, n: Typed) -> Typed:
    text = _text_or_empty(s)
    return _of("str", F.when(_int(n) <= 0, "").otherwise(F.substring(text, F.greatest(F.length(text) - _int(n), F.lit(0)) + 1, F.length(text))), s, n, also=n.value.isNull())


def _mid(s: Typed, start: Typed, n: Typed) -> Typed:
    begin = F.greatest(_int(start) - 1, F.lit(0))
    return _of("str", _slice(_text_or_empty(s), begin, begin + _int(n)), s, start, n, also=start.value.isNull() | n.value.isNull())


def _named(x: Typed) -> Column:
    """As text, with null as the word None, as the language's replacing and finding see it."""
    return F.coalesce(x.value.cast("string") if x.kind in ("str", "null") else text_of(x).value, F.lit("None"))


def _substitute(s: Typed, old: Typed, new: Typed) -> Typed:
    text, a, b = _text_or_empty(s), _named(old), _named(new)
    spread = F.concat(b, F.call_function("array_join", F.split(text, ""), b), F.when(text == "", "").otherwise(b))
    return _of("str", F.when(a == "", spread).otherwise(F.replace(text, a, b)), s, old, new)


def _value(s: Typed) -> Typed:
    if s.kind in NUMBERS:
        return _of("float", F.coalesce(_float(s), F.lit(0.0)), s)
    trimmed = F.regexp_replace(F.coalesce(s.value, F.lit("")), r"^\s+|\s+$", "")
    number = trimmed.try_cast("double")
    return _of("float", F.when(trimmed == "", 0.0).otherwise(number), s, also=(trimmed != "") & number.isNull())


def _extreme(pick) -> Callable[..., Typed]:
    def run(*xs: Typed) -> Typed:
        missing = reduce(lambda a, b: a | b, [x.value.isNull() for x in xs])
        if len(xs) < 2 or not (all(x.kind in NUMBERS for x in xs) or len({x.kind for x in xs}) == 1):
            return _of("float", F.lit(None).cast("double"), *xs, also=F.lit(True))
        same = _common([_number(x) for x in xs])
        return _of(same[0].kind, pick(*(x.value for x in same)), *xs, also=missing)

    return run


def _zero(x: Typed) -> Column:
    return F.coalesce(_float(x), F.lit(0.0))


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two with half of its digits each."""
    c = F.lit(134217729.0) * x
    high = c - (c - x)
    return high, x - high


def _rounded(x: Column, scale: Column) -> Column:
    """``x * scale`` rounded half to even as if the product were exact: where the product looks like a tie, the
    error of the multiplication tells on which side it lies."""
    product = x * scale
    (a, b), (c, d) = _halves(x), _halves(scale)
    error = ((a * c - product) + a * d + b * c) + b * d
    tie = product - F.floor(product) == 0.5
    return F.when(tie & (error > 0), F.ceil(product)).when(tie & (error < 0), F.floor(product)).otherwise(F.rint(product)).cast("double")


def _round(x: Typed, digits: Typed | None = None) -> Typed:
    """Half to even, of the binary value."""
    if digits is None:
        return _of("int", F.rint(_zero(x)).cast("long"), x)
    d, value = _int(digits), _zero(x)
    scale = F.pow(F.lit(10.0), F.abs(d))
    rounded = F.when(d >= 0, _rounded(value, scale) / scale).otherwise(F.rint(value / scale) * scale)
    return _of("float", rounded, x, digits, also=digits.value.isNull())


def _mod(a: Typed, b: Typed) -> Typed:
    y = F.when(_zero(b) == 0, 1.0).otherwise(_zero(b))
    return _of("float", _zero(a) - y * F.floor(_zero(a) / y), a, b)


def _date(y: Typed, m: Typed, d: Typed) -> Typed:
    made = F.call_function("try_make_timestamp", _int(y), _int(m), _int(d), F.lit(0), F.lit(0), F.lit(0))
    return _of("date", made.cast("date"), y, m, d, also=made.isNull())


def _add_months(x: Typed, n: Typed) -> Typed:
    if x.kind not in ("date", "time", "null"):
        return _of("date", F.lit(None).cast("date"), x, n, also=F.lit(True))
    months = _int(n)
    value = F.add_months(x.value.cast("date"), months) if x.kind != "time" else x.value + F.make_ym_interval(F.lit(0), months)
    return _of("time" if x.kind == "time" else "date", value, x, n, also=x.value.isNotNull() & n.value.isNull())


def _length(x: Typed) -> Typed:
    if x.kind != "str":
        return _of("int", F.lit(None).cast("long"), x, also=F.lit(True))
    return _of("int", F.length(x.value).cast("long"), x, also=x.value.isNull())


def _absolute(x: Typed) -> Typed:
    if x.kind not in NUMBERS:
        return _of("float", F.lit(None).cast("double"), x, also=F.lit(True))
    return _of(_number(x).kind, F.abs(_number(x).value), x, also=x.value.isNull())


def _fallback(x: Typed, other: Typed) -> Typed:
    x, other = _common([x, other])
    return _of(other.kind if x.kind == "null" else x.kind, F.when(is_blank(x), other.value).otherwise(x.value), x, other)


def _blank(x: Typed) -> Typed:
    return _of("bool", is_blank(x), x)


def exactly(*ns: int) -> Callable[[int], bool]:
    return lambda n: n in ns


def at_least(k: int) -> Callable[[int], bool]:
    return lambda n: n >= k


#: By name: the numbers of arguments, and the function; None stands for what needs the compiler's date.
FUNCTIONS: dict[str, tuple[Callable[[int], bool], Callable[..., Typed] | None]] = {
    "ISBLANK": (exactly(1), _blank), "ISNULL": (exactly(1), _blank), "IF": (exactly(3), _if), "CASE": (lambda n: n >= 4 and n % 2 == 0, _case),
    "AND": (at_least(1), lambda *xs: _logic(list(xs), True)), "OR": (at_least(1), lambda *xs: _logic(list(xs), False)),
    "NOT": (exactly(1), lambda x: _of("bool", ~truthy(x), x)), "LEN": (exactly(1), _length),
    "UPPER": (exactly(1), lambda x: _of("str", F.upper(_text_or_empty(x)), x)), "LOWER": (exactly(1), lambda x: _of("str", F.lower(_text_or_empty(x)), x)),
    "TRIM": (exactly(1), lambda x: _of("str", F.regexp_replace(_text_or_empty(x), r"^\s+|\s+$", ""), x)),
    "LEFT": (exactly(2), _left), "RIGHT": (exactly(2), _right), "MID": (exactly(3), _mid), "SUBSTITUTE": (exactly(3), _substitute),
    "FIND": (exactly(2), lambda a, b: _of("int", F.call_function("instr", _text_or_empty(b), _named(a)).cast("long"), a, b)),
    "BEGINS": (exactly(2), lambda a, b: _of("bool", F.startswith(_text_or_empty(a), _text_or_empty(b)), a, b)),
    "CONTAINS": (exactly(2), lambda a, b: _of("bool", F.contains(_text_or_empty(a), _text_or_empty(b)), a, b)),
    "ISPICKVAL": (exactly(2), lambda a, b: _of("bool", equal(a, b), a, b)),
    "TODAY": (exactly(0), None), "NOW": (exactly(0), None), "DATE": (exactly(3), _date), "ADDMONTHS": (exactly(2), _add_months),
    "MAX": (at_least(1), _extreme(F.greatest)), "MIN": (at_least(1), _extreme(F.least)), "ROUND": (exactly(1, 2), _round),
    "FLOOR": (exactly(1), lambda x: _of("int", F.floor(_zero(x)), x)), "CEILING": (exactly(1), lambda x: _of("int", F.ceil(_zero(x)), x)),
    "MOD": (exactly(2), _mod), "ABS": (exactly(1), _absolute), "TEXT": (exactly(1), text_of), "VALUE": (exactly(1), _value),
    "BLANKVALUE": (exactly(2), _fallback), "NULLVALUE": (exactly(2), _fallback),
}


def compile_node(node: Node, schema: T.StructType, of: Callable[[str], Column] = F.col, as_of: str | None = None) -> Typed:
    """The value and error of a tree over records of ``schema``; ``of`` gives the column of a top-level field, and
    ``as_of`` (an ISO time, UTC) fixes TODAY and NOW."""
    if node.kind == "literal":
        kind = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}[type(node.value)]
        return Typed(kind, F.lit(node.value).cast("string") if kind == "null" else F.lit(node.value).cast("long") if kind == "int" else F.lit(node.value), _no())
    if node.kind == "ref":
        return _field(schema, node.value, of)
    args = [compile_node(a, schema, of, as_of) for a in node.args]
    if node.kind == "unary":
        (x,) = args
        if node.value == "!":
            return _of("bool", ~truthy(x), x)
        if x.kind not in NUMBERS:
            return _of("float", F.lit(None).cast("double"), x, also=F.lit(True))
        return _of(_number(x).kind, -_number(x).value, x, also=x.value.isNull())
    if node.kind == "binary":
        return _binary(node.value, *args)
    if node.value in ("TODAY", "NOW"):
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        return Typed("time", now, _no()) if node.value == "NOW" else Typed("date", now.cast("date"), _no())
    return FUNCTIONS[node.value][1](*args)


def compile_formula(text: str, schema: T.StructType, of: Callable[[str], Column] = F.col, as_of: str | None = None) -> Typed:
    return compile_node(parse(text), schema, of, as_of)


def evaluate(df, **formulas: str):
    """``df`` with two columns for each formula: its value, null where it fails, and ``<name>_error``."""
    made = {name: compile_formula(text, df.schema) for name, text in formulas.items()}
    return df.select("*", *(F.when(~x.error, x.value).alias(n) for n, x in made.items()), *(x.error.alias(f"{n}_error") for n, x in made.items()))
