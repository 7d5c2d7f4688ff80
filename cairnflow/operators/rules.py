"""Declarative rules, compiled to columns and run as an ordered pipeline over records.

A rule reads a record and either judges it (validation) or computes fields. The pipeline runs the steps of the
order of execution; each is one projection over the record's columns, so a batch of records goes through all of it
without leaving the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow import model as M
from cairnflow.functions import formula as L

#: The steps that run, in this order; a refire runs the first and the third of them once more.
ORDER, REFIRED, WORKFLOW_STEP, VALIDATION_STEP = (5, 6, 9, 10, 11, 12, 13), (5, 9), 12, 6


class StepNotInScope(RuntimeError):
    """A step that was excluded from the engine would run."""


@dataclass(frozen=True)
class Rule:
    """``build`` turns a record into the rule's outcome: the truth of a validation (true: failed), or mutations as
    (field, value, condition). ``reads`` and ``writes`` name fields."""

    rule_id: str
    sobject: str
    step: int
    kind: str
    build: Callable[["Record"], "L.Typed | list[Mutation]"] = field(compare=False)
    reads: frozenset[str] = frozenset()
    writes: frozenset[str] = frozenset()
    message: str = ""


@dataclass(frozen=True)
class Mutation:
    field: str
    value: L.Typed
    when: Column


@dataclass
class Record:
    """A record's columns and their types, by field."""

    schema: T.StructType
    prefix: str = ""
    as_of: str | None = None

    def column(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def formula(self, text: str) -> L.Typed:
        return L.compile_formula(text, self.schema, self.column, self.as_of)

    def typed(self, path: str) -> L.Typed:
        return L.compile_node(L.Node("ref", tuple(path.split("."))), self.schema, self.column)


# --- criteria ---------------------------------------------------------------------------------------------------


def _literal(text: str) -> L.Node:
    """A number where the text is one, but for leading zeros; else the text."""
    if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?", text):
        number = float(text)
        return L.Node("literal", int(number) if number.is_integer() else number)
    return L.Node("literal", text)


def criterion(record: Record, path: str, operation: str, value: str) -> L.Typed:
    """One item of a condition: (field, operation, value)."""
    x = record.typed(path.split(".", 1)[1] if "." in path else path)
    y = L.compile_node(_literal(value), record.schema)
    ops = {"notEqual": "<>", "lessThan": "<", "greaterThan": ">", "lessOrEqual": "<=", "greaterOrEqual": ">="}
    if operation in ops:
        return L._binary(ops[operation], x, y)
    text, wanted = F.coalesce(x.value.cast("string"), F.lit("")), F.lit(value)
    if operation in ("contains", "includes"):
        return L.Typed("bool", F.contains(text, wanted), x.error)
    if operation == "startsWith":
        return L.Typed("bool", F.startswith(text, wanted) & x.value.isNotNull(), x.error)
    return L._binary("=", x, y)


def conjunction(record: Record, items: list[tuple[str, str, str]]) -> L.Typed:
    """All items hold; an item behind a false one is not looked at."""
    if not items:
        return L.Typed("bool", F.lit(True), F.lit(False))
    return L._logic([criterion(record, *i) for i in items], True)


def _fields(items: list[tuple[str, str, str]]) -> frozenset[str]:
    return frozenset(i[0].split(".", 1)[-1] for i in items)


# --- compilers by kind of definition ----------------------------------------------------------------------------


def validation(rule_id: str, sobject: str, text: str, message: str = "") -> Rule:
    """Fails a record where the formula is true. Inactive ones are compiled like others."""
    return Rule(rule_id, sobject, VALIDATION_STEP, "validation", lambda r: r.formula(text), frozenset(L.references(L.parse(text))), message=message or f"{rule_id} failed")


def formula_field(rule_id: str, sobject: str, name: str, text: str) -> Rule:
    """Computes a field; a null result leaves it as it is."""

    def build(r: Record) -> list[Mutation]:
        value = r.formula(text)
        return [Mutation(name, value, value.value.isNotNull())]

    return Rule(rule_id, sobject, VALIDATION_STEP, "computation", build, frozenset(L.references(L.parse(text))), frozenset([name]))


def workflow(sobject: str, rules: list[dict], updates: dict[str, dict]) -> Rule | None:
    """One rule for a file: the active rules' field updates (field, and literal or formula), each under its rule's
    criteria or formula over the incoming record, so the last one that applies wins. Actions without an update are
    skipped; without an active rule there is nothing to run."""
    active = [r for r in rules if r.get("active")]
    if not active:
        return None

    def build(record: Record) -> list[Mutation]:
        out = []
        for r in active:
            guard = record.formula(r["formula"]) if r.get("formula") else conjunction(record, r.get("criteria", []))
            for action in r.get("actions", []):
                u = updates.get(action)
                if u is None:
                    continue
                value = record.formula(u["formula"]) if u.get("formula") else L.compile_node(_literal(u["literal"]), record.schema)
                hit = L.truthy(guard)
                out.append(Mutation(u["field"], L.Typed(value.kind, value.value, guard.error | (hit & value.error)), hit))
        return out

    writes = frozenset(updates[a]["field"] for r in active for a in r.get("actions", []) if a in updates)
    reads = frozenset(x for r in active for x in ([*L.references(L.parse(r["formula"]))] if r.get("formula") else _fields(r.get("criteria", []))))
    return Rule(f"{sobject}.workflow", sobject, WORKFLOW_STEP, "computation", build, reads, writes)


def assignment(rule_id: str, sobject: str, groups: list[dict]) -> Rule | None:
    """Sets OwnerId by the first entry that applies, of the active groups in order."""
    entries = [e for g in groups if g.get("active") for e in g.get("entries", [])]
    if not entries:
        return None

    def build(record: Record) -> list[Mutation]:
        taken, error, value = F.lit(False), F.lit(False), F.lit(None).cast("string")
        for e in entries:
            guard = record.formula(e["formula"]) if e.get("formula") else conjunction(record, e.get("criteria", []))
            error = error | (~taken & guard.error)
            value = F.when(taken, value).when(L.truthy(guard), F.lit(e["owner"])).otherwise(value)
            taken = taken | L.truthy(guard)
        return [Mutation("OwnerId", L.Typed("str", value, error), taken)]

    return Rule(rule_id, sobject, 10, "computation", build, frozenset().union(*(_fields(e.get("criteria", [])) for e in entries)), frozenset(["OwnerId"]))


def flow(rule_id: str, sobject: str, updates: dict[str, object], trigger_type: str = "RecordAfterSave", calls: int = 0, subflows: int = 0, screens: int = 0) -> Rule:
    """Sets the fields of a flow's record updates, all of them: decisions are not evaluated. Flows that call out,
    have screens or subflows cannot be compiled."""
    if calls or subflows or screens:
        raise ValueError(f"{rule_id}: calls, subflows and screens are not compiled")

    def build(record: Record) -> list[Mutation]:
        return [Mutation(k, L.compile_node(L.Node("literal", v), record.schema), F.lit(True)) for k, v in updates.items()]

    return Rule(rule_id, sobject, 5 if trigger_type == "RecordBeforeSave" else 13, "computation", build, frozenset(), frozenset(updates))


def urgent_route(text: Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("urgent")), "high_priority").otherwise("standard_queue")


# --- the pipeline -----------------------------------------------------------------------------------------------

RESULT = "array<struct<rule_id:string,step:int,kind:string,passed:boolean,error:string>>"


def commuting(rules: list[Rule]) -> bool:
    """Whether the order of rules within their step cannot be seen in the record."""
    return all(not (a.writes & (b.reads | b.writes)) for a in rules for b in rules if a is not b)


def catalog(spark, rules: list[Rule]) -> DataFrame:
    """The rules as a table."""
    rows = [(r.rule_id, r.sobject, r.step, r.kind, sorted(r.reads), sorted(r.writes)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, sobject string, step int, kind string, reads array<string>, writes array<string>")


def rules_for(events: DataFrame, catalog_table: DataFrame) -> DataFrame:
    """Rules that apply to events (sobject, step)."""
    return events.join(catalog_table.select("sobject", "step", "rule_id", "kind"), ["sobject", "step"])


def _sql(kind: str) -> str:
    return {"int": "long", "float": "double", "str": "string", "bool": "boolean", "date": "date", "time": "timestamp", "null": "string"}[kind]


def _value(outcome: L.Typed, to: T.DataType | None) -> Column:
    return outcome.value.cast(to) if to is not None else outcome.value.cast(_sql(outcome.kind))


def run(records: DataFrame, rules: list[Rule], excluded: tuple[int, ...] = (), as_of: str | None = None) -> DataFrame:
    """Records with the fields that rules have set, and _results, _aborted, _abort_reason, _refired.

    Rules run by step, and by rule id within one; each sees what those before it wrote. A computation that fails
    writes nothing. After a step with failed validations a record is aborted: later steps leave it, what was
    written stays. If the workflow step wrote anything, the before and after steps run once more. Using an excluded
    step is an error even if no rule stands in it.
    """
    if bad := [s for s in ORDER if s in excluded]:
        raise StepNotInScope(f"step {bad[0]} ({M.STEPS[bad[0] - 1]}) is excluded")
    no_text = F.lit(None).cast("string")
    df = records.select("*", F.array().cast(RESULT).alias("_results"), F.lit(False).alias("_aborted"), no_text.alias("_abort_reason"), F.lit(False).alias("_refired"))
    for step, guard in [*((s, F.lit(True)) for s in ORDER), *((s, F.col("_refired")) for s in REFIRED)]:
        own = sorted((r for r in rules if r.step == step), key=lambda r: r.rule_id)
        live = ~F.col("_aborted") & guard
        wrote: list[Column] = []
        for group in _groups(own):
            df, changed = _apply(df, group, live, as_of)
            wrote += changed
        if step == WORKFLOW_STEP and wrote:
            df = df.withColumn("_refired", live & F.exists("_results", lambda x: (x["step"] == WORKFLOW_STEP) & x["error"].eqNullSafe(F.lit("wrote"))))
        if any(r.kind == "validation" for r in own):
            failed = F.filter("_results", lambda x: (x["kind"] == "validation") & ~x["passed"])
            reason = F.concat(F.lit("validation failed: "), F.array_join(F.transform(failed, lambda x: x["error"]), "; "))
            df = df.withColumns({"_aborted": F.col("_aborted") | (live & (F.size(failed) > 0)), "_abort_reason": F.when(live & (F.size(failed) > 0), reason).otherwise(F.col("_abort_reason"))})
    shown = F.transform("_results", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["step"].alias("step"), x["kind"].alias("kind"), x["passed"].alias("passed"), F.when(x["error"] != "wrote", x["error"]).alias("error")))
    return df.withColumn("_results", shown)


def trace(txn: Column, sobject: Column, depth: Column | None = None, cascaded: Column | None = None) -> Column:
    """What ``run`` did with a record, as lines of text; ``depth`` and ``cascaded`` count child saves and DML."""
    told = lambda x: F.when(x, "True").otherwise("False")
    number = lambda x: F.coalesce(x if x is not None else F.lit(0), F.lit(0)).cast("string")
    line = lambda name, value: F.concat(F.lit(name + "="), value)
    return F.array(
        line("txn", txn.cast("string")), line("sobject", sobject), line("refire", told(F.col("_refired"))), line("refire_done", told(F.col("_refired"))), line("cascade_depth", number(depth)),
        line("rule_results", F.size("_results").cast("string")), line("cascaded_dml", number(cascaded)), F.concat(F.lit("aborted="), told(F.col("_aborted")), F.lit("("), F.coalesce("_abort_reason", F.lit("None")), F.lit(")")),
    )


def _groups(own: list[Rule]) -> list[list[Rule]]:
    """Runs of rules that commute; each is one projection."""
    groups: list[list[Rule]] = []
    for r in own:
        if groups and commuting([*groups[-1], r]):
            groups[-1].append(r)
        else:
            groups.append([r])
    return groups


def _apply(df: DataFrame, group: list[Rule], live: Column, as_of: str | None) -> tuple[DataFrame, list[Column]]:
    record = Record(T.StructType([f for f in df.schema if not f.name.startswith("_")]), as_of=as_of)
    types = {f.name: f.dataType for f in record.schema}
    new: dict[str, Column] = {}
    results, wrote = [], []
    for rule in group:
        outcome = rule.build(record)
        if rule.kind == "validation":
            failed = outcome.error | L.truthy(outcome)
            result = F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.step).alias("step"), F.lit("validation").alias("kind"), (~failed).alias("passed"), F.when(outcome.error, f"{rule.rule_id} error").when(failed, rule.message).alias("error"))
        else:
            error = reduce(lambda a, b: a | b, [m.value.error for m in outcome], F.lit(False))
            hit = F.lit(False)
            for m in outcome:
                ok = live & ~error & m.when
                hit = hit | (~error & m.when)
                was = new.get(m.field, F.col(m.field) if m.field in types else F.lit(None).cast(_sql(m.value.kind)))
                new[m.field] = F.when(ok, _value(m.value, types.get(m.field))).otherwise(was)
            wrote.append(hit)
            result = F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.step).alias("step"), F.lit("computation").alias("kind"), (~error).alias("passed"), F.when(error, f"{rule.rule_id} error").when(hit, "wrote").alias("error"))
        results.append(result)
    more = F.when(live, F.array(*results).cast(RESULT)).otherwise(F.array().cast(RESULT))
    return df.withColumns({**new, "_results": F.concat("_results", more)}), wrote


def once_per_entity(saves: DataFrame) -> DataFrame:
    """Saves (txn, seq, sobject, record_id) with fires: flows run for the first save of an entity in a transaction;
    without an id the transaction stands for it."""
    entity = F.coalesce(F.nullif("record_id", F.lit("")), F.col("txn").cast("string"))
    first = F.row_number().over(W.partitionBy("txn", "sobject", entity).orderBy("seq"))
    return saves.withColumn("fires", first == 1)


def cascade(saves: DataFrame, limit: int = M.CASCADE_LIMIT) -> DataFrame:
    """Saves with depth, the number of child saves so far in the transaction, which never falls, and exceeded."""
    depth = F.row_number().over(W.partitionBy("txn").orderBy("seq")) - 1
    return saves.withColumn("depth", depth).withColumn("exceeded", depth > limit)


def mixed_objects(saves: DataFrame) -> DataFrame:
    """Saves with conflict: the first of a transaction at which both setup and other objects have been saved."""
    setup = F.lower("sobject").isin(M.SETUP_OBJECTS)
    upto = W.partitionBy("txn").orderBy("seq")
    both = F.bool_or(setup).over(upto) & F.bool_or(~setup).over(upto)
    marked = saves.withColumn("_both", both)
    return marked.withColumn("conflict", F.col("_both") & ~F.coalesce(F.lag("_both").over(upto), F.lit(False))).drop("_both")


def rule_order(rule_ids: DataFrame, seed: int, txns: DataFrame) -> DataFrame:
    """A reproducible order of rules for each transaction: by a hash of seed, transaction and rule."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("txn").cast("string"), "rule_id"))
    pairs = txns.select("txn").crossJoin(F.broadcast(rule_ids.select("rule_id")))  # the rules are the program, not data
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("txn").orderBy(key, "rule_id")))


def shuffled(rule_ids: list[str], seed: int, txn: str) -> list[str]:
    """The order in which a generator seeded with both deals the sorted rules, for one transaction."""
    import random

    out = sorted(rule_ids)
    random.Random(f"{seed}:{txn}").shuffle(out)
    return out
