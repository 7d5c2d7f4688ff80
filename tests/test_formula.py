"""The compiled formula language against a small model of its semantics."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairnflow.functions import formula as L

FIELDS = {"a": "long", "x": "double", "s": "string", "b": "boolean"}


class Stop(Exception):
    pass


def run(node, record):
    """A node's value by the language's rules; Stop where it fails."""
    if node.kind == "literal":
        return node.value
    if node.kind == "ref":
        return record.get(node.value[0])
    if node.kind == "unary":
        v = run(node.args[0], record)
        if node.value == "!":
            return not v
        if v is None or isinstance(v, str):
            raise Stop
        return -v
    if node.kind == "binary":
        op = node.value
        left = run(node.args[0], record)
        if op == "&&":
            return run(node.args[1], record) if left else left
        if op == "||":
            return left if left else run(node.args[1], record)
        right = run(node.args[1], record)
        if op == "=":
            return left == right
        if op in ("<>", "!="):
            return left != right
        if left is None or right is None or isinstance(left, str) != isinstance(right, str):
            raise Stop
        if op in ("<", "<=", ">", ">="):
            return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        if isinstance(left, str):
            if op == "+":
                return left + right
            raise Stop
        if op == "/" and right == 0:
            raise Stop
        return {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: left / right}[op]()
    args = node.args
    if node.value == "IF":
        return run(args[1] if run(args[0], record) else args[2], record)
    values = [run(a, record) for a in args]
    if node.value == "ISBLANK":
        return values[0] is None or (isinstance(values[0], str) and not values[0].strip())
    if node.value == "NOT":
        return not values[0]
    if node.value == "LEN":
        if not isinstance(values[0], str):
            raise Stop
        return len(values[0])
    if node.value == "LEFT":
        if values[1] is None:
            raise Stop
        return str(values[0] or "")[: values[1]]
    if node.value == "MID":
        start = max(values[1] - 1, 0)
        return str(values[0] or "")[start : start + values[2]]
    if node.value == "MOD":
        d = values[1] or 1
        return (values[0] or 0) - d * math.floor((values[0] or 0) / d)
    raise AssertionError(node.value)


N = L.Node
lit = lambda v: N("literal", v)
number = st.one_of(st.integers(-9, 9).map(lit), st.sampled_from([0.5, 2.25]).map(lit), st.sampled_from([N("ref", ("a",)), N("ref", ("x",))]))
text = st.one_of(st.sampled_from(["", " ", "ab", "Straße"]).map(lit), st.just(N("ref", ("s",))))


def numeric(inner):
    return st.one_of(
        st.builds(lambda o, l, r: N("binary", o, (l, r)), st.sampled_from("+-*/"), inner, inner), st.builds(lambda x: N("unary", "-", (x,)), inner),
        st.builds(lambda c, l, r: N("call", "IF", (N("binary", "<", (c, lit(2))), l, r)), inner, inner, inner), st.builds(lambda l, r: N("call", "MOD", (l, r)), inner, inner),
        st.builds(lambda t: N("call", "LEN", (t,)), text),
    )


numbers = st.recursive(number, numeric, max_leaves=6)
texts = st.one_of(text, st.builds(lambda t, k: N("call", "LEFT", (t, lit(k))), text, st.integers(-3, 4)), st.builds(lambda t, a, b: N("call", "MID", (t, lit(a), lit(b))), text, st.integers(-2, 4), st.integers(-3, 4)), st.builds(lambda a, b: N("binary", "+", (a, b)), text, text))
truths = st.one_of(
    st.builds(lambda o, l, r: N("binary", o, (l, r)), st.sampled_from(["=", "<>", "<", ">="]), numbers, numbers), st.builds(lambda x: N("call", "ISBLANK", (x,)), st.one_of(texts, numbers)),
    st.builds(lambda o, l, r: N("binary", o, (l, r)), st.sampled_from(["=", "<>", "<"]), texts, texts), st.just(N("ref", ("b",))),
)
logic = st.recursive(truths, lambda i: st.one_of(st.builds(lambda o, l, r: N("binary", o, (l, r)), st.sampled_from(["&&", "||"]), i, i), st.builds(lambda x: N("call", "NOT", (x,)), i)), max_leaves=4)
RECORDS = [
    {"a": 3, "x": 2.5, "s": "ab", "b": True}, {"a": None, "x": 0.0, "s": None, "b": False}, {"a": 0, "x": None, "s": " ", "b": None}, {"a": -7, "x": -0.5, "s": "Straße", "b": True},
]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(nodes=st.lists(st.one_of(numbers, texts, logic), min_size=8, max_size=8))
def test_equals_model(spark, nodes):
    df = spark.createDataFrame([tuple(r.values()) for r in RECORDS], ", ".join(f"{k} {v}" for k, v in FIELDS.items())).coalesce(1)
    made = [L.compile_node(n, df.schema) for n in nodes]
    got = df.select(*(m.value.alias(f"v{k}") for k, m in enumerate(made)), *(m.error.alias(f"e{k}") for k, m in enumerate(made))).collect()
    for record, row in zip(RECORDS, got):
        for k, n in enumerate(nodes):
            try:
                want = run(n, record)
            except Stop:
                assert row[f"e{k}"], (n, record)
                continue
            assert row[f"e{k}"] is False, (n, record)
            value = row[f"v{k}"]
            if isinstance(want, float) or isinstance(value, float):
                assert value == pytest.approx(want)
            else:
                assert value == want, (n, record)


@pytest.mark.parametrize("text", ["1 +", "FOO(1)", "a < b < c", "a $ b", "IF(1, 2)", "CASE(a, 1, 2)", "(a", "a)", "REGEX(s)"])
def test_rejects(text):
    with pytest.raises(L.FormulaError):
        L.parse(text)


CASES = {
    "SUBSTITUTE('abc', '', '-')": "-a-b-c-", "FIND('l', 'hello')": 3, "RIGHT('abc', 0)": "", "RIGHT('abc', 2)": "bc", "TEXT(3.0)": "3", "TEXT(TRUE)": "true", "TEXT(NULL)": "", "VALUE(' 1.5 ')": 1.5, "VALUE('')": 0.0,
    "MOD(-7.5, 2)": 0.5, "MOD(7, 0)": 0.0, "ROUND(2.5)": 2, "ROUND(2.675, 2)": 2.67, "FLOOR(-1.5)": -2, "CEILING(NULL)": 0, "BLANKVALUE('  ', 'x')": "x", "CASE(NULL, 1, 'a', NULL, 'b', 'c')": "b", "UPPER(NULL)": "",
    "AND(FALSE, 1/0)": False, "OR(1, 1/0)": 1, "IF(TRUE, 1, 1/0)": 1, "1 = '1'": False, "TRUE = 1": True, "NULL = NULL": True, "BEGINS('abc', '')": True, "CONTAINS('abc', 'bc')": True, "MAX(1, 2.5)": 2.5, "ISPICKVAL('a', 'a')": True, "'ab' * 2": "abab",
}
FAILS = ["1 / 0", "NULL + 1", "'a' + 1", "LEN(1)", "LEN(NULL)", "VALUE('x')", "MAX(1)", "MAX(1, NULL)", "ABS(NULL)", "DATE(2023, 2, 30)", "1 < 'a'", "-NULL", "AND(TRUE, 1/0)", "LEFT('a', NULL)"]


def test_fixed_cases(spark):
    df = spark.range(1)
    made = {t: L.compile_formula(t, df.schema) for t in [*CASES, *FAILS]}
    row = df.select(*(m.value.alias(f"v{k}") for k, m in enumerate(made.values())), *(m.error.alias(f"e{k}") for k, m in enumerate(made.values()))).first()
    for k, t in enumerate(made):
        assert row[f"e{k}"] is (t in FAILS), t
        if t in CASES:
            assert row[f"v{k}"] == CASES[t], t


def test_dates_and_paths(spark):
    df = spark.createDataFrame([(("x",),)], "Account struct<Email:string>")
    texts = ["TODAY()", "ADDMONTHS(DATE(2024, 1, 31), 1)", "NOW()", "Account.Email", "Account.Owner.Email"]
    row = df.select(*(L.compile_formula(t, df.schema, as_of="2024-03-01 10:00:00").value.cast("string").alias(str(k)) for k, t in enumerate(texts))).first()
    assert list(row) == ["2024-03-01", "2024-02-29", "2024-03-01 10:00:00", "x", None]
