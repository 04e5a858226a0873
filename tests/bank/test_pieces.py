import random

from itemforge.functions import matrix
from itemforge.operators import pieces
from pyspark.sql import functions as F

LINE = "line int, ord int, text string, bold boolean"


def smoothed(parts):
    """The two rules, one after the other, each from left to right over what it has changed."""
    parts = [list(p) for p in parts]
    words = [p for p in parts if p[0].strip()]
    for i, p in enumerate(words):
        if not p[1] and sum(c.isalnum() for c in p[0]) <= 3 and 0 < i < len(words) - 1 and words[i - 1][1] and words[i + 1][1]:
            p[1] = True
    for i, p in enumerate(parts):
        if not p[0].strip():
            p[1] = 0 < i < len(parts) - 1 and parts[i - 1][1] and parts[i + 1][1]
    return [p[1] for p in parts]


def test_smoothing_equals_two_passes(spark):
    rng = random.Random(3)
    lines = {k: [(rng.choice(["e", "de", " ", "  ", "forte", "(a)"]), rng.random() < 0.6) for _ in range(rng.randrange(1, 12))] for k in range(300)}
    rows = spark.createDataFrame([(k, i, t, b) for k, x in lines.items() for i, (t, b) in enumerate(x)], LINE)
    got: dict = {}
    for r in pieces.smooth_pieces(rows, ["line"], ["ord"]).orderBy("line", "ord").collect():
        got.setdefault(r.line, []).append(r.bold)
    assert got == {k: smoothed(x) for k, x in lines.items()}


def test_pieces_of_a_page(spark):
    m = lambda x, y, c=0.0, d=0.0: (1.0, 0.0, c, d, float(x), float(y))
    items = [
        (1, 1, 0, "alternativa", m(40, 700), 60.0, 10.0, "B", True),
        (1, 1, 1, " ", m(100, 700), 4.0, 10.0, "F", False),
        (1, 1, 2, "CORRETA", m(104, 698), 40.0, 0.0, "B", True),  # height 8, for want of any
        (1, 1, 3, "de", m(150, 700, 3.0, 4.0), 10.0, None, "F", None),  # a gap; height 5
        (1, 1, 4, "x", m(158, 700), None, 10.0, None, None),  # overlaps
        (1, 1, 5, "below", m(40, 697.4), 20.0, 10.0, "F", False),  # 2.6 from the first
        (1, 1, 6, "right", m(300, 700), 20.0, 10.0, "F", False),
        (1, 1, 7, "", m(40, 600), 5.0, 10.0, "F", False),
        (1, 1, 8, None, m(40, 600), 5.0, 10.0, "F", False),
        (2, 1, 0, "elsewhere", m(0, 0), 5.0, 10.0, "F", False),  # no such page
    ]
    items = spark.createDataFrame(items, f"doc int, page int, ord int, text string, matrix {matrix.MATRIX}, width double, height double, font string, bold boolean")
    pages = spark.createDataFrame([(1, 1, (1.0, 0.0, 0.0, -1.0, 0.0, 800.0), 600.0, False)], f"doc int, page int, view {matrix.MATRIX}, width double, one_column boolean")
    got = pieces.piece_lines(pieces.text_pieces(items, pages)).orderBy("col", "line_no").collect()
    assert [(r.col, r.text, r.marked) for r in got] == [(0, "alternativa CORRETA de x", "**alternativa CORRETA** de x"), (0, "below", "below"), (1, "right", "right")]
    first = got[0]
    assert (first.x0, first.x1, first.y0, first.y1, first.base) == (40, 160, 90, 102.5, 100)
    assert [(p.text, p.height) for p in first.pieces] == [("alternativa", 10), (" ", 10), ("CORRETA", 8), (" de", 5), (" x", 10)]
    assert pieces.piece_lines(pieces.text_pieces(items.limit(0), pages)).count() == 0


def test_matrices(spark):
    turn, move = matrix.matrix(0, 2, -3, 0, 5, 7), matrix.matrix(1, 0, 0, 1, 10, 20)
    row = spark.range(1).select(
        matrix.placed(matrix.combined(turn, move), 1, 2).alias("once"),
        F.expr("1").alias("one"),
        matrix.placed(turn, 11, 22).alias("twice"),
        matrix.placed_box(turn, matrix.box(0, 0, 1, 2)).alias("box"),
        matrix.shared_box(matrix.box(0, 0, 4, 4), matrix.box(2, -1, 9, 3)).alias("both"),
        matrix.shared_box(F.lit(None).cast(matrix.BOX), matrix.box(2, -1, 9, 3)).alias("other"),
    ).first()
    assert row.once == row.twice == (-61, 29)
    assert row.box == (-1, 7, 5, 9) and row.both == (2, 0, 4, 3) and row.other == (2, -1, 9, 3)


def test_smoothing_of_a_row_equals_two_passes(spark):
    rng = random.Random(5)
    lines = {k: [(rng.choice(["e", "de", " ", "  ", "forte", "(a)"]), rng.random() < 0.6) for _ in range(rng.randrange(1, 12))] for k in range(300)}
    rows = spark.createDataFrame(list(lines.items()), "line int, p array<struct<text: string, bold: boolean>>")
    got = {r.line: [p.bold for p in r.p] for r in rows.select("line", pieces.smooth_row(F.col("p")).alias("p")).collect()}
    assert got == {k: smoothed(x) for k, x in lines.items()}
