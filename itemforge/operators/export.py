"""Exports: the fixed sheet, nested documents, review rows and seed statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: The columns of the sheet, fixed.
SHEET = ("Nº", "Título", "Instituição", "Ano", "Disciplina", "Tópico", "Dificuldade", "Enunciado", "Alternativa A", "Alternativa B", "Alternativa C", "Alternativa D", "Alternativa E", "Gabarito", "Explicação do Professor")


def option_text(options: Column, letter: str) -> Column:
    return F.coalesce(F.get(F.filter(options, lambda o: o["letter"] == letter), F.lit(0))["text"], F.lit(""))


def sheet(questions: DataFrame) -> DataFrame:
    """The 15 columns, all filled; the last is always empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = [t.two_digits(F.col("number")), F.col("title"), blank("institution"), blank("year"), F.col("discipline"), F.col("topic"), F.col("difficulty"), F.col("statement"), *[option_text(F.col("options"), x) for x in "ABCDE"], F.col("answer"), F.lit("")]
    return questions.select(*[v.alias(n) for v, n in zip(values, SHEET)])


def write_sheet(questions: DataFrame, path: str) -> None:
    """CSV parts with a header and quoted line ends; spreadsheet programs open them."""
    sheet(questions).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_documents(nested: DataFrame, path: str) -> None:
    """One JSON line per document."""
    nested.write.option("ignoreNullFields", False).json(path)


def payload(nested: DataFrame) -> DataFrame:
    """What an import takes: without pictures of questions, figures by name and address
    (null for those not uploaded yet)."""
    figure = lambda f: F.struct(f["name"].alias("name"), (f["url"] if "url" in fields else F.lit(None).cast("string")).alias("url"))
    fields = _figure_fields(nested)
    drop = lambda q: q.dropFields("image", "source_text", "outside").withField("figures", F.transform(q["figures"], figure))
    return nested.withColumn("questions", F.transform("questions", drop))


def _figure_fields(nested: DataFrame) -> list[str]:
    return nested.schema["questions"].dataType.elementType["figures"].dataType.elementType.names


def upload_figures(nested: DataFrame, address: Column) -> DataFrame:
    """nested with the address of each figure; address is a column over the figure's path."""
    with_url = lambda q: q.withField("figures", F.transform(q["figures"], lambda f: f.withField("url", F.concat(address, figure_path(F.col("hash"), f["name"])))))
    return nested.withColumn("questions", F.transform("questions", with_url))


def review_page(questions: DataFrame) -> DataFrame:
    """(doc, json): the questions of a document as JSON that may stand in a page."""
    rows = F.array_sort(F.collect_list(F.struct("number", F.to_json(F.struct(*questions.columns)).alias("json"))))
    joined = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["json"]), ","), F.lit("]"))
    return questions.groupBy("doc").agg(t.script_safe(joined).alias("json"))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def sql_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def topic_tuples(topics: DataFrame) -> DataFrame:
    """(discipline, topic, tuple): each topic as a value tuple of a seed statement."""
    items = F.array_join(F.transform("subjects", sql_literal), ", ")
    row = F.concat(F.lit("("), sql_literal(F.col("discipline")), F.lit(", "), sql_literal(F.col("topic")), F.lit(", ARRAY["), items, F.lit("]::text[])"))
    return topics.select("discipline", "topic", row.alias("tuple"))


def in_pieces(text: Column, size: int) -> Column:
    """text cut in pieces of size letters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def from_pieces(df: DataFrame, keys: list[str], piece: str = "piece", order: str = "ord") -> DataFrame:
    """(keys, content): base64 pieces in order, decoded."""
    rows = F.array_sort(F.collect_list(F.struct(order, piece)))
    return df.groupBy(*keys).agg(F.unbase64(F.array_join(F.transform(rows, lambda x: x[piece]), "")).alias("content"))


def figure_path(hash_: Column, name: Column) -> Column:
    """Where a figure lies in the object store."""
    return F.concat_ws("/", F.substring(hash_, 1, 16), F.concat(name, F.lit(".png")))
