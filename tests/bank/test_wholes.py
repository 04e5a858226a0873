import tempfile

from itemforge.operators import whole
from pyspark.sql import functions as F

LINES = "doc long, page int, col int, line_no int, text string, marked string, pieces array<struct<text: string, bold: boolean, font: string, x0: double, x1: double, base: double, height: double>>, x0 double, y0 double, x1 double, y1 double, base double"
PARTS = "doc long, page int, col int, part int, ord int, kind string, question int, x0 double, y0 double, x1 double, y1 double"
INKS = "doc long, page int, x0 double, y0 double, x1 double, y1 double, image boolean"
IMAGES = "doc long, page int, ord int, x0 double, y0 double, x1 double, y1 double"


def line(page, no, base, *pieces, col=0):
    """Pieces are (text, x0, x1) or (text, x0, x1, True) for bold."""
    own = [(p[0], len(p) > 3, "F", float(p[1]), float(p[2]), float(base), 10.0) for p in pieces]
    text = "".join(p[0] for p in own)
    return (1, page, col, no, text, text, own, own[0][3], base - 10.0, max(p[4] for p in own), base + 2.5, float(base))


def contents(spark, parts, lines, inks=(), images=()):
    make = spark.createDataFrame
    p = make([(1, pg, 0, part, part, kind, q, 0.0, float(y0), 600.0, float(y1)) for pg, part, kind, q, y0, y1 in parts], PARTS)
    got = whole.part_contents(p, make(list(lines), LINES), make([(1, pg, *map(float, b), im) for pg, b, im in inks], INKS), make([(1, pg, k, *map(float, b)) for k, (pg, b) in enumerate(images)], IMAGES), f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return p, got


def test_a_line_belongs_to_the_first_brace(spark):
    rows = [line(1, k, 60 + 20 * k, ("a", 10, 30), (f"x = {k}", 60, 90)) for k in range(1, 5)]
    inks = [(1, (45, 72, 52, 102), False), (1, (46, 73, 53, 142), False), (1, (40, 71, 44, 141), True)]  # two braces that overlap, an image as slim as one
    _, got = contents(spark, [(1, 1, "continued", 1, 50, 400)], rows, inks)
    r = got.first()
    assert r.lines[0].startswith("a ⟦FÓRMULA #1 = $\\begin{cases} x = 1 \\\\ x = 2 \\end{cases}$⟧")
    assert r.lines[1] == "" and r.lines[2].startswith("a ⟦FÓRMULA #2 = $\\begin{cases} x = 3 \\\\ x = 4") and r.lines[3] == ""
    assert [(f.k, f.image, f.latex is not None) for f in r.formulas] == [(0, True, False), (1, False, True), (2, False, True)]
    # where the first brace can't be read, the second has its lines
    rows[0] = line(1, 1, 80, ("a", 10, 30), ("words", 60, 90))
    _, got = contents(spark, [(1, 1, "continued", 1, 50, 400)], rows[:1] + [line(1, 2, 100, ("x < 1", 60, 90)), line(1, 3, 120, ("x > 2", 60, 90))], [(1, (45, 72, 52, 102), False), (1, (46, 92, 53, 122), False)])
    assert [f.latex for f in got.first().formulas] == [None, "\\begin{cases} x < 1 \\\\ x > 2 \\end{cases}"]


def test_marks_between_pieces(spark):
    rows = [line(1, 1, 80, ("Questão 7", 10, 80)), line(1, 2, 100, ("uma ", 10, 30, True), ("duas ", 30, 60, True), ("três", 90, 110), ("quatro", 140, 180, True)), line(1, 3, 300, ("far right", 400, 500))]
    inks = [(1, (62, 90, 85, 101), False), (1, (115, 88, 135, 104), False), (1, (5, 91, 9, 99), False), (1, (30, 72, 50, 84), False)]  # before, between, first, on the bar
    _, got = contents(spark, [(1, 1, "new", 7, 60, 400)], rows, inks)
    assert got.first().lines == ["Questão 7", "⟦FÓRMULA #0⟧", "⟦FÓRMULA #3⟧ **uma duas** ⟦FÓRMULA #2⟧ três ⟦FÓRMULA #1⟧ **quatro**", "far right"]


def test_questions_over_parts(spark):
    parts = [(1, 1, "new", 3, 60, 400), (2, 2, "continued", 3, 30, 400), (3, 3, "continued", 3, 30, 90), (3, 4, "new", 4, 90, 400), (4, 5, "continued", None, 30, 400)]
    rows = [line(1, 1, 80, ("Questão 3", 10, 80)), line(1, 2, 100, ("text of it", 10, 300)), line(2, 1, 60, ("more", 10, 300)), line(2, 2, 200, ("end", 10, 300)), line(3, 1, 110, ("Questão 4", 10, 80)), line(4, 1, 90, ("nobody's", 10, 90))]
    inks = [(1, (10, 120, 40, 140), False), (2, (10, 100, 40, 110), True)]
    images = [(1, (10, 150, 110, 200)), (2, (200, 62, 300, 180)), (2, (10, 64, 110, 170)), (3, (10, 40, 110, 85)), (3, (10, 10, 110, 29))]
    p, got = contents(spark, parts, rows, inks, images)
    out = {r.question: r for r in whole.question_contents(p, got).collect()}
    assert out[3].text.split("\n") == ["Questão 3", "text of it", "⟦FÓRMULA Q03_f1⟧", "⟦FIGURA Q03_fig1⟧", "more", "⟦FIGURA Q03_fig2⟧", "⟦FIGURA Q03_fig3⟧", "⟦FÓRMULA Q03_f2⟧", "end", "⟦FIGURA Q03_fig4⟧"]
    assert [(f.name, f.of.image) for f in out[3].formulas] == [("Q03_f1", False), ("Q03_f2", True)]
    assert [(f.name, f.of.x0) for f in out[3].figures] == [("Q03_fig1", 10.0), ("Q03_fig2", 10.0), ("Q03_fig3", 200.0), ("Q03_fig4", 10.0)]
    assert out[4].text == "Questão 4" and out[4].figures == [] and set(out) == {3, 4}
    ends = {r.part: (r.y0, r.y1, len(r.lines)) for r in got.collect()}
    assert ends[1] == (60.0, 208.0, 3) and ends[2] == (44.0, 210.5, 3) and ends[3] == (34.0, 90.0, 0)


def test_nothing_there(spark):
    p, got = contents(spark, [(1, 1, "new", 1, 60, 400)], [])
    r = got.first()
    assert (r.lines, r.formulas, r.figures, r.y0, r.y1) == ([], [], [], 60.0, 400.0)
    assert whole.question_contents(p, got).select("text").first().text == ""
    assert got.where(F.lit(False)).count() == 0
