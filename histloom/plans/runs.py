"""Benchmark bookkeeping: tasks, answers, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.functions.text import answers_match, first_nonempty
from histloom.operators.skew import PAGE_ROWS, lookup_join, nest


def without_attachments(tasks: DataFrame) -> DataFrame:
    """Tasks that need no file."""
    blank = F.lit("")
    path = first_nonempty(F.coalesce("file_path", blank), F.coalesce("file_name", blank))
    return tasks.filter(path == "")


def task_by_id(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.filter(F.col("task_id") == task_id)


def result_records(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One record per run: the task, its outcome, and whether the answer is right. Further
    columns of the outcomes, such as a run id, stay."""
    error = F.col("error")
    more = [c for c in outcomes.columns if c not in ("task_id", "system_answer", "execution_time", "error")]
    runs = lookup_join(outcomes, tasks, ["task_id"], "inner")
    return runs.select(
        *more,
        "task_id",
        "question",
        "expected_answer",
        "system_answer",
        "execution_time",
        error.isNull().alias("success"),
        answers_match(
            F.coalesce("system_answer", F.lit("None")), F.coalesce("expected_answer", F.lit("None"))
        ).alias("answer_match"),
        error,
        F.coalesce(F.contains(F.lower(error), F.lit("timed out")), F.lit(False)).alias("timed_out"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals, times and rates of a run in one row; means are 0 and rates null without runs."""
    total = F.count(F.lit(1))
    ok, right = F.count_if("success"), F.count_if("answer_match")
    return results.agg(
        total.alias("total_tasks"),
        ok.alias("successful_tasks"),
        F.count_if(~F.col("success")).alias("failed_tasks"),
        F.count_if("timed_out").alias("timed_out_tasks"),
        right.alias("correct_answers"),
        F.coalesce(F.sum("execution_time"), F.lit(0.0)).alias("total_execution_time"),
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("average_execution_time"),
        (F.try_divide(right, total) * 100).alias("accuracy"),
        (F.try_divide(ok, total) * 100).alias("success_rate"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """The summary as lines of text."""
    lines = [
        F.lit("BENCHMARK SUMMARY"),
        F.repeat(F.lit("="), 50),
        F.lit(""),
        F.format_string("Total Tasks: %d", "total_tasks"),
        F.format_string("Successful Tasks: %d", "successful_tasks"),
        F.format_string("Failed Tasks: %d", "failed_tasks"),
        F.format_string("Timed Out Tasks: %d", "timed_out_tasks"),
        F.format_string("Correct Answers: %d", "correct_answers"),
        F.format_string("Accuracy: %.1f%%", "accuracy"),
        F.format_string("Success Rate: %.1f%%", "success_rate"),
        F.format_string("Total Execution Time: %.2f seconds", "total_execution_time"),
        F.format_string("Average Execution Time: %.2f seconds", "average_execution_time"),
    ]
    return summary.select(F.concat_ws("\n", *lines).alias("text"))


def result_line(df: DataFrame) -> DataFrame:
    """One line of text per result, and a second one for an error."""
    yes = lambda c: F.when(F.col(c), "True").otherwise("False")
    line = F.concat(
        F.lit("Task "), F.col("task_id"), F.lit(": Success="), yes("success"),
        F.lit(", Match="), yes("answer_match"), F.format_string(", Time=%.2fs", "execution_time"),
        F.when(F.col("timed_out"), ", TIMED OUT").otherwise(""),
    )
    error = F.concat(F.lit("  Error: "), F.left("error", F.lit(100)), F.lit("..."))
    return df.select("*", F.concat_ws("\n", line, error).alias("line"))


def report_lines(results: DataFrame, order: str) -> DataFrame:
    """The text report: part 0 is the summary, part 1 the heading of the details, part 2 a line
    per result in the order of `order`, which is unique. Sorted by (part, place), the lines are
    the report."""
    zero = F.lit(0).cast("long").alias("place")
    top = summary_text(run_summary(results)).select(F.lit(0).alias("part"), zero, F.concat("text", F.lit("\n")).alias("line"))
    heading = F.concat(F.lit("DETAILED RESULTS:\n"), F.repeat(F.lit("-"), 50))
    head = results.sparkSession.range(1).select(F.lit(1).alias("part"), zero, heading.alias("line"))
    lines = result_line(results).select(F.lit(2).alias("part"), F.col(order).cast("long").alias("place"), "line")
    return top.unionByName(head).unionByName(lines)


def summary_json(results: DataFrame, order: str, max_rows: int = PAGE_ROWS) -> DataFrame:
    """The summary with its results as JSON documents, one for each page of `max_rows` results;
    the totals are those of the whole run on every page. Rates are left to the reader."""
    fields = [
        "task_id", "question", "expected_answer", "system_answer", "execution_time", "success", "answer_match",
        "error", "timed_out",
    ]
    pages = nest(results.withColumn("_run", F.lit(0)), ["_run"], [order], fields, "results", max_rows)
    totals = run_summary(results).drop("accuracy", "success_rate")
    whole = pages.drop("_run").crossJoin(F.broadcast(totals))  # totals are one row
    document = F.struct(*totals.columns, "results")
    return whole.select("part", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
