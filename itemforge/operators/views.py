"""Read views of the bank: filters, search, list summaries, readable questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def bank_filter(questions: DataFrame, text: str | None = None, subject: str | None = None, years: tuple[int, int] | None = None, **equal) -> DataFrame:
    """Questions that meet all given conditions; equal names columns and values. Plain
    comparisons reach the scan; text is looked up without case and marks."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v is not None]
    if years:
        tests.append(F.col("year").between(*years))
    if subject:
        tests.append(F.array_contains("subjects", subject))
    if text:
        tests.append(F.contains(t.fold(t.search_text(F.col("statement"))), t.fold(F.lit(text))))
    return questions.where(reduce(lambda a, b: a & b, tests)) if tests else questions


def question_rows(questions: DataFrame, issues: DataFrame, doc: str = "doc") -> DataFrame:
    """Light rows with a stable id and counts of issues."""
    per = issues.groupBy(doc, "number").agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    q = questions.join(per, [doc, "number"], "left")
    return q.select(F.concat_ws("/", doc, t.two_digits(F.col("number"))).alias("id"), doc, "number", "title", "institution", "year", "discipline", "topic", "subjects", "difficulty", "stage", t.search_text(F.col("statement"), 400).alias("search"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def review_rows(rows: DataFrame, show: str = "all") -> DataFrame:
    return rows.where({"all": "true", "errors": "errors > 0", "warnings": "warnings > 0"}[show])


def question_by_id(rows: DataFrame, qid: str) -> DataFrame:
    """The row with this id; an id that names a path outside the bank finds none."""
    return rows.limit(0) if ".." in qid or qid.startswith("/") else rows.where(F.col("id") == qid)


def list_summary(lists: DataFrame, members: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per list: questions found, members that dangle, questions with errors and with
    warnings. keys join members with rows; counts are partial before the shuffle."""
    r = rows.select(*keys, "errors", "warnings", F.lit(True).alias("_there"))
    m = members.join(r, keys, "left").groupBy("list_id").agg(
        F.count_if(F.col("_there")).alias("questions"), F.count_if(F.col("_there").isNull()).alias("dangling"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("warnings") > 0).alias("with_warnings")
    )
    return lists.join(m, "list_id", "left").na.fill(0, ["questions", "dangling", "with_errors", "with_warnings"])


def list_counts(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Lists with the number of their members."""
    return lists.join(members.groupBy("list_id").agg(F.count(F.lit(1)).alias("total")), "list_id", "left").na.fill(0, ["total"])


def list_questions(members: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The questions of lists in their order; members that dangle are left out."""
    return members.join(rows, keys).orderBy("list_id", "position")


def readable(questions: DataFrame, members: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Questions that are published, or members of a published list."""
    shown = members.join(lists.where("status = 'publicada'").select("list_id"), "list_id", "left_semi").select(*keys).distinct().withColumn("_shown", F.lit(True))
    return questions.join(shown, keys, "left").where(F.col("published") | F.coalesce("_shown", F.lit(False))).drop("_shown")


def ready_imports(documents: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Documents all of whose questions are transcribed. documents has total."""
    done = transcribed.groupBy("doc").agg(F.count(F.lit(1)).alias("_done"))
    return documents.join(done, "doc").where("_done >= total").drop("_done")


def pending(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: resuming skips what is done."""
    return questions.join(done, keys, "left_anti")


def hard_questions(questions: DataFrame, least: int = 4) -> DataFrame:
    """Questions of at least this difficulty, for a list of its own."""
    return questions.where(F.col("difficulty") >= least)


def stage_summary(questions: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, stage, first, last): the numbers between which each stage's questions lie."""
    return questions.where("stage is not null").groupBy(doc, "stage").agg(F.min("number").alias("first"), F.max("number").alias("last"))


def figure_count(questions: DataFrame, doc: str = "doc") -> DataFrame:
    return questions.groupBy(doc).agg(F.sum(F.coalesce(F.size("figures"), F.lit(0))).alias("figures"))


def outcomes(results: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """How many results ended in each way."""
    return results.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def union_banks(banks: list[DataFrame]) -> DataFrame:
    """The questions of several imports as one bank; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), banks)
