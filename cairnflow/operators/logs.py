"""Debug logs: lines, transactions and their comparison with the rules.

Lines: file, line_no, value. Every order is within a file, so files are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnflow import model as M

#: The kind of a line by the first word of its event.
KINDS = {
    "EXECUTION_STARTED": "execution_started", "EXECUTION_FINISHED": "execution_finished", "CODE_UNIT_STARTED": "code_unit_started", "CODE_UNIT_FINISHED": "code_unit_finished",
    "DML_BEGIN": "dml_begin", "DML_END": "dml_end", "FLOW_START_INTERVIEW_BEGIN": "flow_start", "FLOW_START_INTERVIEW_END": "flow_end",
    "VALIDATION_RULE": "validation_rule", "VALIDATION_PASS": "validation_pass", "VALIDATION_FAIL": "validation_fail", "USER_INFO": "user_info",
}


def classify(lines: DataFrame) -> DataFrame:
    """Lines with time, nanos, kind (null where the line has no time or an unknown event) and body."""
    part = lambda k: F.regexp_extract("value", M.LOG_LINE, k)
    word = F.substring_index(part(3), "|", 1)
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), word)
    timed = part(1) != ""
    return lines.select("file", "line_no", F.when(timed, part(1)).alias("time"), F.when(timed, part(2).cast("long")).alias("nanos"), F.when(timed, kind).alias("kind"), F.when(timed, part(3)).alias("body"))


def parse_stats(classified: DataFrame) -> DataFrame:
    return classified.groupBy("file").agg(F.count("kind").alias("classified"), F.count_if(F.col("kind").isNull()).alias("unclassified"))


def sessions(classified: DataFrame) -> DataFrame:
    """The lines inside transactions, with txn (from 1 in each file): a start opens one, its first finish closes it,
    and a new start opens the next; other lines belong to none."""
    upto = W.partitionBy("file").orderBy("line_no")
    started = classified.filter("kind is not null").withColumn("txn", F.count_if(F.col("kind") == "execution_started").over(upto))
    own = W.partitionBy("file", "txn").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    closed = F.coalesce(F.count_if(F.col("kind") == "execution_finished").over(own), F.lit(0))
    return started.withColumn("_closed", closed).filter("txn > 0 and _closed = 0").drop("_closed")


def dml_ops(in_txn: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("body", M.LOG_DML, k)
    return in_txn.filter("kind = 'dml_begin'").filter(F.col("body").rlike(M.LOG_DML)).select("file", "txn", "line_no", part(1).cast("int").alias("at_line"), part(2).alias("op"), part(3).alias("object"), part(4).cast("int").alias("n_rows"))


def transactions(in_txn: DataFrame) -> DataFrame:
    """One row a transaction: start, end, events after the one that opens it, DML operations, failed rules, flows and the last user."""
    failure = F.when(F.col("kind") == "validation_fail", F.nullif(F.regexp_extract("body", M.LOG_FAILURE, 1), F.lit("")))
    flow = F.when(F.col("kind") == "flow_start", F.element_at(F.split("body", r"\|"), -1))
    user = F.nullif(F.regexp_extract("body", M.LOG_USER, 1), F.lit(""))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("line_no", x.alias("v"))))), lambda s: s["v"])
    return in_txn.groupBy("file", "txn").agg(
        F.min_by("time", "line_no").alias("started"), F.max(F.when(F.col("kind") == "execution_finished", F.col("time"))).alias("finished"), F.count_if(F.col("kind") != "execution_started").alias("n_events"),
        F.count_if((F.col("kind") == "dml_begin") & F.col("body").rlike(M.LOG_DML)).alias("n_dml"), ordered(failure).alias("failures"), ordered(flow).alias("flows"),
        F.max_by(user, F.when(user.isNotNull(), F.col("line_no"))).alias("user_id"),
    )


def timestamps(classified: DataFrame, day: str) -> DataFrame:
    """The lines' times on a given day, to the millisecond."""
    clock = F.regexp_extract("time", r"^(\d{2}:\d{2}:\d{2}\.\d{1,3})", 1)
    return classified.withColumn("at", F.to_timestamp(F.concat(F.lit(day + " "), clock)))


def compare(logged: DataFrame, predicted: DataFrame) -> DataFrame:
    """By transaction, the failures of the log (file, txn, failures) against those the rules predict (file, txn,
    failed): what only one side has, and the divergence."""
    rows = logged.select("file", "txn", F.col("failures").alias("l")).join(predicted.select("file", "txn", F.col("failed").alias("r")), ["file", "txn"], "left")
    empty = F.array().cast("array<string>")
    left, right = F.coalesce("l", empty), F.coalesce("r", empty)
    only_log, only_rules = F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
    clean = (F.size(only_log) == 0) & (F.size(only_rules) == 0)
    return rows.select("file", "txn", only_log.alias("only_in_log"), only_rules.alias("only_in_rules"), (~clean).alias("diverged"), F.when(clean, 0).otherwise(50).alias("severity"), F.when(~clean, "ooe_ordering_mismatch").alias("category"))


def explanation(only_log: Column, only_rules: Column, aborted: Column, log_clean: Column) -> Column:
    """How a transaction's two sides differ, in words."""
    listed = lambda xs: F.concat(F.lit("['"), F.array_join(xs, "', '"), F.lit("']"))
    parts = (
        F.when(F.size(only_rules) > 0, F.concat(F.lit("runtime fired but log did not: "), listed(only_rules))), F.when(F.size(only_log) > 0, F.concat(F.lit("log fired but runtime did not: "), listed(only_log))),
        F.when(aborted & log_clean, "runtime aborted; production accepted the txn"),
    )
    same = (F.size(only_rules) == 0) & (F.size(only_log) == 0)
    return F.when(same, "runtime + log agree on validation outcomes").otherwise(F.concat_ws("; ", *parts))


def replay(logged: DataFrame, states: DataFrame, rules: list) -> DataFrame:
    """``compare`` with what the rules say: they run over the transactions' records (file, txn, fields). A transaction
    of several records fails where one of them does; one without a record fails no rule. Adds failed, aborted and
    explanation."""
    from cairnflow.operators.rules import run

    missed = F.transform(F.filter("_results", lambda x: (x["kind"] == "validation") & ~x["passed"]), lambda x: x["rule_id"])
    predicted = run(states, rules).groupBy("file", "txn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(missed)))).alias("failed"), F.bool_or("_aborted").alias("aborted"))
    empty = F.array().cast("array<string>")
    known = logged.select("file", "txn", (F.size(F.coalesce("failures", empty)) == 0).alias("_log_clean"))
    rows = compare(logged, predicted).join(predicted, ["file", "txn"], "left").join(known, ["file", "txn"])
    rows = rows.withColumns({"failed": F.coalesce("failed", empty), "aborted": F.coalesce("aborted", F.lit(False))})
    return rows.withColumn("explanation", explanation(F.col("only_in_log"), F.col("only_in_rules"), F.col("aborted"), F.col("_log_clean"))).drop("_log_clean")


def replay_summary(compared: DataFrame) -> DataFrame:
    """Totals and the clean share as a whole percent, rounded down."""
    return compared.agg(F.count(F.lit(1)).alias("total"), F.count_if("diverged").alias("diverged")).withColumn("clean_percent", F.when(F.col("total") == 0, 0).otherwise(F.floor((F.col("total") - F.col("diverged")) * 100 / F.greatest("total", F.lit(1)))).cast("long"))
