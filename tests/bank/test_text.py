import unicodedata

import pytest
from itemforge.functions import text as t
from pyspark.sql import functions as F


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("text", ["Ação Ñandú", "x² ½ ﬁ", "İ ß", "", None])
def test_decomposition_is_pythons(spark, text):
    want = None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    assert value(spark, t.decompose(F.col("x")), x=text) == want


def test_white_space_of_all_kinds(spark):
    assert value(spark, t.strip(F.col("x")), x="  a b\n") == "a b"
    assert value(spark, t.squeeze(F.col("x")), x=" a \n b ") == "a b"
    assert value(spark, t.lines(F.col("x")), x="a\nb\r\nc\n") == ["a", "b", "c"]


def test_latex(spark):
    x = "a $x_{1}$ R\\$ 5 $$y{$$ ≤ R$ 9"
    assert value(spark, t.odd_dollars(F.col("x")), x=x) is True
    assert value(spark, t.money_unescaped(F.col("x")), x=x) is True
    assert value(spark, t.unbalanced(F.col("x")), x=x) == ["$$y{$$"]
    assert value(spark, t.unsupported(F.col("x")), x="$\\ce{H2O} \\SI{1}{m}$") == ["\\ce{", "\\SI{"]
    assert value(spark, t.symbols_outside(F.col("x")), x="$≤$ ² ≥ ²") == sorted("²≥")
    assert value(spark, t.latex_of_line(F.col("x")), x="x ≤  3·y") == "x \\le 3\\cdot y"
    assert value(spark, t.latex_of_line(F.col("x")), x="no relation") == ""
    assert value(spark, t.cases_of(F.col("x")), x=["a=1", "b=2"]) == "\\begin{cases} a=1 \\\\ b=2 \\end{cases}"


def test_markdown(spark):
    assert value(spark, t.figure_refs(F.col("x")), x='![a](figura:Q01_fig1) <img src="figura:Q2">') == ["Q01_fig1", "Q2"]
    assert value(spark, t.table_heads(F.col("x")), x="a\n| h |\n| r |\nb\n |x|") == ["| h |", " |x|"]
    assert value(spark, t.bold_spans(F.col("x")), x="**a**<strong>b</strong><thead>c</thead>") == ["a", "b", "c"]
    assert value(spark, t.key(F.col("x")), x="\\frac <b>Ação</b>, 2!") == "acao2"
    assert value(spark, t.bold_marked(F.col("x")), x=" a b ") == " **a b** "
    got = value(spark, t.replace_figures(F.col("x"), F.array(F.struct(F.lit("f1").alias("name"), F.lit("u1").alias("url")))), x="figura:f1 figura:f10")
    assert got == "u1 figura:f10"
    assert value(spark, t.escape_html(F.col("x")), x='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"


@pytest.mark.parametrize(
    ("source", "number", "institution", "year"),
    [("Questão 07  UNICAMP 2014", 7, "UNICAMP", 2014), ("Questao 1 2 (Adaptada) ENEM - 2010/2012", 12, "ENEM - 2010", 2012), ("Questão 3", 3, None, None), ("Questão 4 UFX 201920", 4, "UFX", 2019), ("intro\nQuestão 5 USP", None, "USP", None), ("", None, None, None)],
)
def test_bars(spark, source, number, institution, year):
    assert value(spark, t.bar_number(F.col("x")), x=source) == number
    assert value(spark, t.bar_institution(F.col("x")), x=source) == institution
    assert value(spark, t.bar_year(F.col("x")), x=source) == year


def test_titles(spark):
    args = dict(k="lista", l="MCU", n=7, i="UFX", y=2014)
    title = t.title(F.col("k"), F.col("l"), F.col("n"), F.col("i"), F.col("y"), t.exam_number(F.lit("13_Simulado_1_DIA.pdf")), t.exam_day(F.lit("13_Simulado_1_DIA.pdf")))
    assert value(spark, title, **args) == "Lista de Exercícios - MCU - Questão 07 - UFX 2014"
    assert value(spark, title, **(args | {"k": "simulado", "n": 100})) == "Questão 100 - 13º Simulado Autoral 2026 - 1º DIA"
    assert value(spark, t.exam_day(F.col("x")), x="Simulado DIA 2") == 2


def test_source_against_transcription(spark):
    source = "Questão 1\n[centralizado] **Massa** de 12 kg e 1.500 m\nFonte: livro 99"
    assert value(spark, t.source_body(F.col("x")), x=source) == "Massa de 12 kg e 1.500 m"
    assert value(spark, t.numbers_missing(t.source_body(F.col("x")), F.lit("12 quilos")), x=source) == ["1500"]
    assert value(spark, t.word_coverage(F.col("x"), F.lit("a MASSA")), x="massa tempo") == 0.5
    assert value(spark, t.lines_repeated(F.col("x"), F.lit("linha bem longa; Linha bem longa")), x="bar\nLinha bem longa") == ["linhabemlonga"]
    for letters, bad in ((list("ABCDE"), False), (list("CAB"), False), (list("ABCAB"), True), (["C", "B"], True), (["A"], False), ([], False)):
        assert value(spark, t.letters_out_of_order(F.col("x")), x=letters) is bad
    assert value(spark, t.answer_pairs(F.col("x")), x="1\nA\n 12 \n C\n") == {"01": "A", "12": "C"}


def test_references_and_tables(spark):
    text = "intro\n\n*Fonte: UNICAMP, 2014.*\n \n|a|\nnext"
    assert value(spark, t.format_references(F.col("x")), x=text) == 'intro\n\n<p style="text-align: right;"><sub>Fonte: UNICAMP, 2014.</sub></p>\n \n|a|\nnext'
    again = value(spark, t.format_references(t.format_references(F.col("x"))), x=text)
    assert again == value(spark, t.format_references(F.col("x")), x=text)
    assert value(spark, t.reference_html(F.col("x")), x=" **_Disponível em: <https://a.b> [c](http://d) x<y_**") == ' <p style="text-align: right;"><sub>Disponível em: https://a.b c x&lt;y</sub></p>'
    for p, yes in (("Fonte (adaptada): x", True), ("O livro. Acesso em: 2 jan.", True), ("Texto sobre a fonte", False), ("Fonte: $x$", False), ("", False)):
        assert value(spark, t.is_reference(F.col("x")), x=p) is yes
    assert value(spark, t.separate_tables(F.col("x")), x="a\n|b|\n|c|\nd\n\n|e|") == "a\n\n|b|\n|c|\n\nd\n\n|e|"


def test_numbers(spark):
    from itemforge.functions import numeric as n

    row = spark.createDataFrame([([3.0, 1.0, 3.0, 2.0],)], "a array<double>").select(n.argmax(F.col("a")).alias("i"), n.middle(F.col("a")).alias("m"), n.chosen_probability(F.col("a")).alias("p"), n.confidence(F.array(F.lit(0.5), F.lit(0.125))).alias("c"), n.standardised(F.array(F.lit(2.0), F.lit(2.0))).alias("s"), n.shrink_to(F.lit(2000), F.lit(1150), 1_150_000).alias("k")).first()
    assert (row.i, row.m, row.s) == (0, 3.0, [0.0, 0.0]) and abs(row.p - 1 / (2 + 2.718281828 ** -2 + 2.718281828 ** -1)) < 1e-9
    assert (row.c.least, round(row.c.mean, 9)) == (0.125, 0.25) and abs(row.k - 0.5**0.5) < 1e-12
