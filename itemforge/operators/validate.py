"""Validation: a table of rules, each of which turns a row into an array of issues.

All rules are evaluated in one pass over the questions and exploded once; no rule joins
the questions with themselves. E blocks, W asks for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Difficulties allowed in each stage; notices that a passage wasn't read; lone bank lines.
STAGE_BANDS = {"Fixação": (1, 2), "Treinamento": (2, 3), "Aprofundamento": (3, 4), "Desafios": (4, 5)}
NOT_READ = r"(?iu)n[ãa]o\s+(?:[ée]\s+)?leg[ií]ve|ileg[ií]ve|n[ãa]o\s+(?:foi\s+)?(?:capturad|extra[ií]d|identificad)|n[ãa]o\s+dispon[ií]vel\s+no\s+texto|\((?:express[ãa]o|f[óo]rmula)[^)]*\)"
BANK_ONLY = r"^(?:⟦FIGURA \S+⟧\s*)*[A-ZÀ-Ú][A-ZÀ-Ú0-9ª\-/(). ]*\s(?:19|20)\d{2}(?:/\d)?\s*(?:⟦FIGURA \S+⟧\s*)*$"
CREDIT = r"(?iu)^\s*\(?(?:fonte|dispon[ií]vel)"
_ISSUE = "array<struct<rule:string,severity:string,field:string,detail:string>>"


def _issue(rule: str, severity: str, field: Column | str, detail: Column) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), field.cast("string").alias("field"), detail.cast("string").alias("detail"))


def _if(condition: Column, rule: str, severity: str, field: str, detail: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_issue(rule, severity, field, detail))).otherwise(F.array().cast(_ISSUE))


def _each(values: Column, make) -> Column:
    return F.coalesce(F.transform(values, make), F.array().cast(_ISSUE))


def _over_fields(make) -> Column:
    """Issues of each text field: the statement and the options. make(field, text) gives an array."""
    return F.flatten(F.transform("_fields", lambda f: make(f["field"], f["text"])))


def mixed_cut(source: Column, number: Column) -> Column:
    """Why a question's source text looks mixed with another's; null if it doesn't, or is empty."""
    rows = F.split(source, "\n")
    later = F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
    letters = F.filter(F.transform(rows, lambda x: F.regexp_extract(x, r"^(?:\*\*)?([A-E])(?:\*\*)?\s+\S", 1)), lambda x: x != "")
    first = F.get(rows, F.lit(0))
    return F.when(F.coalesce(source, F.lit("")) == "", None).otherwise(
        F.when(~F.coalesce(t.bar_number(first) == number, F.lit(False)), "does not begin with its own bar")
        .when(F.exists(later, lambda x: x.rlike(r"(?iu)^\s*quest[aã]o\s*\d")), "another question's bar is inside")
        .when(~first.rlike(r"\b(?:19|20)\d{2}\b") & F.exists(later, lambda x: t.strip(x).rlike(BANK_ONLY)), "its bar is torn apart")
        .when(t.letters_out_of_order(letters), "options out of order in the source")
    )


def _formatting(source: Column, transcript: Column) -> Column:
    """Bold runs and centred lines of the source that the transcription lost."""
    rows = t.lines(source)
    body = F.slice(rows, 2, F.size(rows))
    plain = F.transform(body, lambda x: F.regexp_replace(x, r"^\[centralizado\] ", ""))
    runs = F.flatten(F.transform(plain, lambda x: F.regexp_extract_all(x, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))))
    bold, centred = t.joined_keys(t.bold_spans(transcript)), t.joined_keys(t.centred_spans(transcript))
    lost_bold = F.filter(runs, lambda r: (F.length(F.regexp_replace(t.key(r), "[0-9]", "")) >= 4) & (F.instr(bold, t.key(r)) == 0))
    bare = lambda x: F.replace(F.regexp_replace(x, r"^\[centralizado\] ", ""), F.lit("**"), F.lit(""))
    lost_centre = F.filter(body, lambda x: x.startswith(t.CENTRED_MARK) & (F.length(t.key(bare(x))) >= 3) & ~bare(x).rlike(CREDIT) & (F.instr(centred, t.key(bare(x))) == 0))
    return F.concat(
        F.when(F.size(lost_bold) > 0, F.array(_issue("bold_lost", "E", "source", F.array_join(F.slice(lost_bold, 1, 4), "; ")))).otherwise(F.array().cast(_ISSUE)),
        F.when(F.size(lost_centre) > 0, F.array(_issue("centring_lost", "E", "source", F.array_join(F.transform(F.slice(lost_centre, 1, 4), lambda x: t.strip(bare(x))), "; ")))).otherwise(F.array().cast(_ISSUE)),
    )


def rules() -> dict[str, Column]:
    """Columns over questions joined with their topic (subjects_known) and list."""
    letters = F.transform("options", lambda o: o["letter"])
    abc = F.array(*[F.lit(x) for x in "ABCDE"])
    band_lo = F.create_map(*[F.lit(v) for s, (lo, _) in STAGE_BANDS.items() for v in (s, lo)])
    band_hi = F.create_map(*[F.lit(v) for s, (_, hi) in STAGE_BANDS.items() for v in (s, hi)])
    lo, hi = F.try_element_at(band_lo, "stage"), F.try_element_at(band_hi, "stage")
    valid = F.when(F.coalesce(F.size("subjects_known"), F.lit(0)) == 0, F.array("topic")).otherwise(F.col("subjects_known"))
    declared = F.transform(F.coalesce("figures", F.array()), lambda f: f["name"])
    tables = F.transform(F.filter(F.coalesce("figures", F.array()), lambda f: F.coalesce(f["table"], F.lit(False))), lambda f: f["name"])
    used = F.array_distinct(F.flatten(F.transform("_fields", lambda f: t.figure_refs(f["text"]))))
    has_table = F.exists("_fields", lambda f: f["text"].rlike(r"(?m)<table|^\s*\|"))
    body = t.source_body(F.col("source_text"))
    has_source = F.coalesce(F.col("source_text"), F.lit("")) != ""
    missing = t.numbers_missing(body, F.col("_transcript"))
    coverage = t.word_coverage(body, F.col("_transcript"))
    repeated = t.lines_repeated(F.col("source_text"), F.col("_transcript"))
    mixed = mixed_cut(F.col("source_text"), F.col("number"))
    sorted_join = lambda a: F.array_join(F.array_sort(a), ", ")
    return {
        "review_asked": _if(F.col("review"), "review_asked", "W", "question", F.coalesce("notes", F.lit(""))),
        "topic_unknown": _if(~F.col("topic_known"), "topic_unknown", "E", "topic", F.concat_ws(" / ", "discipline", "topic")),
        "topic_not_of_list": _if((F.col("list_kind") == "lista") & ~(F.col("discipline").eqNullSafe(F.col("list_discipline")) & F.col("topic").eqNullSafe(F.col("list_topic"))), "topic_not_of_list", "E", "topic", F.concat_ws(" / ", "discipline", "topic")),
        "options_order": _if((F.size("options") < 2) | (letters != F.slice(abc, F.lit(1), F.greatest(F.size("options"), F.lit(0)))), "options_order", "E", "options", F.array_join(letters, "")),
        "answer_not_an_option": _if(~F.array_contains(letters, F.col("answer")), "answer_not_an_option", "E", "answer", F.col("answer")),
        "not_read": _over_fields(lambda f, x: F.when(x.rlike(NOT_READ), F.array(_issue("not_read", "E", f, F.regexp_extract(x, f"({NOT_READ})", 1)))).otherwise(F.array().cast(_ISSUE))),
        "option_empty": _each(F.filter("options", lambda o: t.strip(o["text"]) == ""), lambda o: _issue("option_empty", "E", F.concat(F.lit("option "), o["letter"]), F.lit(""))),
        "option_starts_with_letter": _each(F.filter("options", lambda o: o["text"].rlike(r"^\(?[a-eA-E][).]\s")), lambda o: _issue("option_starts_with_letter", "W", F.concat(F.lit("option "), o["letter"]), F.substring(o["text"], 1, 20))),
        "difficulty_outside_stage": _if(lo.isNotNull() & ~F.col("difficulty").between(lo, hi), "difficulty_outside_stage", "W", "difficulty", F.col("difficulty")),
        "no_subject": _if(F.coalesce(F.size("subjects"), F.lit(0)) == 0, "no_subject", "E", "subjects", F.lit("")),
        "subject_unknown": _each(F.filter("subjects", lambda s: ~F.array_contains(valid, s)), lambda s: _issue("subject_unknown", "E", "subjects", s)),
        "cut_mixed": _if(mixed.isNotNull(), "cut_mixed", "E", "source", mixed),
        "content_outside": _if(F.size("outside") > 0, "content_outside", "E", "source", F.array_join(F.slice("outside", 1, 3), "; ")),
        "odd_dollars": _over_fields(lambda f, x: F.when(t.odd_dollars(x), F.array(_issue("odd_dollars", "E", f, F.lit("")))).otherwise(F.array().cast(_ISSUE))),
        "money_unescaped": _over_fields(lambda f, x: F.when(t.money_unescaped(x), F.array(_issue("money_unescaped", "E", f, F.lit("")))).otherwise(F.array().cast(_ISSUE))),
        "braces_unbalanced": _over_fields(lambda f, x: F.transform(t.unbalanced(x), lambda m: _issue("braces_unbalanced", "E", f, F.substring(m, 1, 40)))),
        "command_unsupported": _over_fields(lambda f, x: F.transform(t.unsupported(x), lambda c: _issue("command_unsupported", "E", f, c))),
        "symbol_outside_math": _over_fields(lambda f, x: F.when(F.size(t.symbols_outside(x)) > 0, F.array(_issue("symbol_outside_math", "W", f, F.array_join(t.symbols_outside(x), " ")))).otherwise(F.array().cast(_ISSUE))),
        "figure_unknown": _if(F.size(F.array_except(used, declared)) > 0, "figure_unknown", "E", "figures", sorted_join(F.array_except(used, declared))),
        "table_as_figure": _if(F.size(F.array_intersect(tables, used)) > 0, "table_as_figure", "E", "figures", sorted_join(F.array_intersect(tables, used))),
        "table_not_transcribed": _if((F.size(tables) > 0) & (F.size(F.array_intersect(tables, used)) == 0) & ~has_table, "table_not_transcribed", "E", "figures", sorted_join(tables)),
        "figure_unused": _if(F.size(F.array_except(F.array_except(declared, used), tables)) > 0, "figure_unused", "E", "figures", sorted_join(F.array_except(F.array_except(declared, used), tables))),
        "numbers_missing": _if(has_source & (F.size(missing) > 0), "numbers_missing", "E", "source", sorted_join(F.array_distinct(missing))),
        "words_missing": _if(has_source & (coverage < 0.85), "words_missing", "E", "source", F.format_number(coverage * 100, 0)),
        "formatting": F.when(has_source, _formatting(F.col("source_text"), F.col("_transcript"))).otherwise(F.array().cast(_ISSUE)),
        "lines_repeated": _if(has_source & (F.size(repeated) > 0), "lines_repeated", "E", "source", F.array_join(F.slice(repeated, 1, 3), "; ")),
        "number_range": _if(~(F.col("number") > 0), "number_range", "E", "number", F.col("number")),
        "year_range": _if(~F.col("year").between(1900, 2100), "year_range", "E", "year", F.col("year")),
        "difficulty_range": _if(~F.col("difficulty").between(1, 5), "difficulty_range", "E", "difficulty", F.col("difficulty")),
        "stage_unknown": _if(~F.col("stage").isin(*STAGE_BANDS), "stage_unknown", "E", "stage", F.col("stage")),
        "formula_not_read": _over_fields(lambda f, x: F.when(x.contains("⟦FÓRMULA"), F.array(_issue("formula_not_read", "E", f, F.lit("")))).otherwise(F.array().cast(_ISSUE))),
        "latex_incoherent": _over_fields(lambda f, x: F.when(x.rlike(r"\\frac\{\s*\}\{\s*\}") | (t.count_of(x, "\\left") != t.count_of(x, "\\right")), F.array(_issue("latex_incoherent", "E", f, F.lit("")))).otherwise(F.array().cast(_ISSUE))),
    }


def validate(questions: DataFrame, documents: DataFrame, topics: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(doc, number, rule, severity, field, detail): the issues of assembled questions.

    topics (discipline, topic, subjects) is a curated base of some hundred rows; Spark
    broadcasts it by its size. Questions may lack figures, source_text and outside.
    """
    known = topics.select("discipline", "topic", F.col("subjects").alias("subjects_known"), F.lit(True).alias("_known"))
    lists = documents.select("doc", F.col("kind").alias("list_kind"), F.col("discipline").alias("list_discipline"), F.col("topic").alias("list_topic"))
    q = questions
    for c, kind in (("figures", "array<struct<name:string,file:string,centred:boolean,table:boolean>>"), ("source_text", "string"), ("outside", "array<string>")):
        if c not in q.columns:
            q = q.withColumn(c, F.lit(None).cast(kind))
    q = q.join(known, ["discipline", "topic"], "left").join(lists, "doc", "left").withColumn("topic_known", F.coalesce("_known", F.lit(False)))
    options = F.transform("options", lambda o: F.struct(F.concat(F.lit("option "), o["letter"]).alias("field"), F.coalesce(o["text"], F.lit("")).alias("text")))
    q = q.withColumn("_fields", F.concat(F.array(F.struct(F.lit("statement").alias("field"), F.coalesce("statement", F.lit("")).alias("text"))), F.coalesce(options, F.array())))
    q = q.withColumn("_transcript", F.array_join(F.transform("_fields", lambda f: f["text"]), "\n"))
    found = rules()
    found = [found[k] for k in (only or found)]
    return q.select("doc", "number", F.inline(F.concat(*found)))


def totals(issues: DataFrame, keys: list[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))


def may_send(issues: DataFrame, force: bool = False) -> DataFrame:
    """(doc, blocked): errors block, and warnings unless forced."""
    blocked = (F.col("errors") > 0) | ((F.col("warnings") > 0) & F.lit(not force))
    return totals(issues, ["doc"]).select("doc", blocked.alias("blocked"))


def partial_answers(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, without_answer): numbers that the document's answer key lacks."""
    per = questions.groupBy("doc").agg(F.array_sort(F.collect_set(t.two_digits(F.col("number")))).alias("_n"))
    return per.join(documents.select("doc", "answers"), "doc").select("doc", F.array_except("_n", F.coalesce(F.map_keys("answers"), F.array())).alias("without_answer"))


def stage_means(questions: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, stage, mean, falls): the mean difficulty of each stage, and whether it is less
    than that of the stage before."""
    order = F.create_map(*[F.lit(v) for k, s in enumerate(STAGE_BANDS) for v in (s, k)])
    per = questions.where(F.col("stage").isin(*STAGE_BANDS)).groupBy(doc, "stage").agg(F.avg("difficulty").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(doc).orderBy(F.try_element_at(order, "stage")))
    return per.withColumn("falls", F.coalesce(F.col("mean") < before, F.lit(False)))


def allowed(lists: DataFrame) -> DataFrame:
    """Lists whose status and kind are of those that the bank knows."""
    return lists.where(F.col("status").isin("rascunho", "publicada") & F.coalesce(F.col("kind").isin("lista", "simulado"), F.lit(True)))
