"""Readers of files: topic base, transcriptions, documents and staged payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as t
from ..operators.ordered import carry_down


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(discipline, topic, subjects) of a topic base: `DISCIPLINA: name` lines, each
    followed by `- topic` or `- topic: subject; subject` lines. A file is one row range
    here (a curated base is small), so its line numbers are places in the whole text."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    head = F.when(F.col("line").rlike(r"^DISCIPLINA:\s*\S"), t.strip(F.regexp_extract("line", r"^DISCIPLINA:\s*(.+)", 1)))
    rows = carry_down(rows, ["file"], ["n"], head, "discipline")
    entry = r"^-\s*([^:]+?)(?::\s*(.*))?$"
    rows = rows.withColumn("line", t.strip(F.col("line"))).where(F.col("line").rlike(entry) & F.col("discipline").isNotNull())
    subjects = F.filter(F.transform(F.split(F.regexp_extract("line", entry, 2), ";"), t.strip), lambda s: s != "")
    rows = rows.select("discipline", t.strip(F.regexp_extract("line", entry, 1)).alias("topic"), subjects.alias("subjects"), F.struct("file", "n").alias("_at"))
    return rows.groupBy("discipline", "topic").agg(F.max_by("subjects", "_at").alias("subjects"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Answer files `<doc>/ia/Qnn.json` as transcribed questions. Types are given, never
    inferred; a file that isn't JSON fails the read."""
    raw = spark.read.schema(schema.ANSWER_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    options = F.transform("alternativas", lambda a: F.struct(a["letra"].alias("letter"), a["texto"].alias("text")))
    names = {"instituicao": "institution", "ano": "year", "adaptada": "adapted", "disciplina": "discipline", "topico": "topic", "assuntos": "subjects", "dificuldade": "difficulty", "enunciado": "statement"}
    doc = F.url_decode(F.regexp_extract("_file", r"([^/]+)/[^/]+/[^/]+$", 1))
    return raw.select(doc.alias("doc"), F.col("numero").alias("number"), *[F.col(a).alias(b) for a, b in names.items()], options.alias("options"), F.col("gabarito").alias("answer"), F.col("revisar").alias("review"), F.col("observacoes").alias("notes"))


def read_list_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, answers, discipline, topic) of list files `<doc>/ia/lista.json`."""
    raw = spark.read.schema(schema.LIST_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    doc = F.url_decode(F.regexp_extract("_file", r"([^/]+)/[^/]+/[^/]+$", 1))
    return raw.select(doc.alias("doc"), F.col("gabarito").alias("answers"), "classificacao.disciplina", "classificacao.topico").toDF("doc", "answers", "discipline", "topic")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash, content) of the PDF files under path that may be taken in: by name
    (no leading dot or underscore) and by their first bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    rows = raw.select(name.alias("file"), F.sha2("content", 256).alias("hash"), "content")
    return rows.where(~F.col("file").rlike("^[._]") & (F.substring("content", 1, 4) == F.lit("%PDF").cast("binary")))


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The Parquet table at path, or an empty one if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(ddl).parquet(path) if there else spark.createDataFrame([], ddl)


def payload_questions(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """The questions of JSON payloads, typed: empty strings are null where the bank has
    null, absent arrays are empty, review is false by default."""
    kind = "hash_pdf STRING, questoes ARRAY<STRUCT<numero: STRING, titulo: STRING, instituicao: STRING, ano: STRING, disciplina: STRING, topico: STRING, assuntos: ARRAY<STRING>, etapa: STRING, dificuldade: STRING, enunciado: STRING, alternativas: MAP<STRING, STRING>, gabarito: STRING, pagina: STRING, revisar: BOOLEAN, observacoes: STRING>>"
    q = payloads.select(F.from_json(json, kind, {"mode": "FAILFAST"}).alias("p")).select(F.col("p.hash_pdf").alias("hash"), F.inline("p.questoes"))
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("int")
    options = F.transform(F.array_sort(F.map_entries("alternativas")), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text")))
    return q.select("hash", number("numero").alias("number"), F.col("titulo").alias("title"), F.nullif("instituicao", F.lit("")).alias("institution"), number("ano").alias("year"), F.col("disciplina").alias("discipline"), F.col("topico").alias("topic"), F.coalesce("assuntos", F.array()).alias("subjects"), F.col("etapa").alias("stage"), number("dificuldade").alias("difficulty"), F.col("enunciado").alias("statement"), options.alias("options"), F.col("gabarito").alias("answer"), number("pagina").alias("page"), F.coalesce("revisar", F.lit(False)).alias("review"), F.col("observacoes").alias("notes"))
