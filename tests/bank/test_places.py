import random

from itemforge import schema
from itemforge.operators import ordered, segment, spatial
from pyspark.sql import functions as F


def test_anchors_are_not_chains(spark):
    rows = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([1, 3, 4, 10])], "k string, v double, i int")
    got = {r.v: r.line_no for r in ordered.anchor_groups(rows, ["k"], "v", ["v", "i"], 2.5).collect()}
    assert got == {1: 1, 3: 1, 4: 2, 10: 3}
    gaps = {r.v: r.group_no for r in ordered.gap_groups(rows, ["k"], F.col("v"), ["v"], 2).collect()}
    assert gaps == {1: 1, 3: 1, 4: 1, 10: 2}


def test_anchors_equal_a_loop(spark):
    rng = random.Random(0)
    values = {k: [round(rng.uniform(0, 40), 1) for _ in range(30)] for k in range(5)}
    rows = spark.createDataFrame([(k, v, i) for k, x in values.items() for i, v in enumerate(x)], "k int, v double, i int")
    want = {}
    for k, x in values.items():
        anchor, n = None, 0
        for v, i in sorted((v, i) for i, v in enumerate(x)):
            if anchor is None or abs(v - anchor) >= 2.5:
                anchor, n = v, n + 1
            want[k, i] = n
    assert {(r.k, r.i): r.line_no for r in ordered.anchor_groups(rows, ["k"], "v", ["v", "i"], 2.5).collect()} == want


def test_bands_of_rectangles(spark):
    rows = spark.createDataFrame([("p", 0.0, 10.0, 1), ("p", 4.0, 12.0, 2), ("p", 11.0, 20.0, 3)], "k string, y0 double, y1 double, i int")
    assert {r.i: r.band for r in ordered.bands(rows, ["k"]).collect()} == {1: 1, 2: 1, 3: 2}


def test_owner_and_strays(spark):
    boxes = spark.createDataFrame([("d", 1, 10.0, 10.0, 110.0, 50.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    items = spark.createDataFrame([("d", 1, 5.0, 20.0, 115.0, 22.0), ("d", 1, 0.0, 20.0, 50.0, 22.0), ("d", 1, 20.0, 60.0, 30.0, 62.0)], boxes.schema)
    assert sorted(r.x0 for r in spatial.outside_all(items, boxes, ["doc", "page"]).collect()) == [0, 20]
    parts = spark.createDataFrame([("d", 1, "top", 10.0, 0), ("d", 1, "low", 50.0, 1)], "doc string, page int, part string, y0 double, ord int")
    got = {r.x0: r.part for r in spatial.owner(items, parts, ["doc", "page"], ["doc", "page", "x0"]).collect()}
    assert got == {5: "top", 0: "top", 20: "low"}


def page_of(spark):
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 600.0, 800.0), ("d", 3, 600.0, 800.0)], schema.PAGE)

    def span(page, block, text, x0, y0, x1, bold=False):
        return ("d", page, block, 0, 0, text, "Arial-Bold" if bold else "Arial", 0, float(x0), float(y0), float(x1), y0 + 10.0, y0 + 9.0)

    spans = [span(1, 1, "Questão 1 UFX 2014", 20, 100, 280), span(1, 2, "body one", 20, 120, 200), span(1, 3, "strong", 20, 140, 80, True), span(1, 4, "Questão 2 USP 2015", 20, 400, 280), span(1, 5, "body two", 20, 420, 200)]
    spans += [span(1, 6, "rest of two", 320, 60, 500), span(1, 7, "Questão 3", 320, 300, 580), span(1, 8, "body three", 320, 320, 500), span(2, 1, "more of three", 20, 100, 200), span(3, 1, "nothing", 20, 790, 90)]
    return pages, spark.createDataFrame(spans, schema.SPAN), spark.createDataFrame([], schema.IMAGE), spark.createDataFrame([], schema.DRAWING)


def test_questions_run_over_columns_and_pages(spark):
    pages, spans, images, drawings = page_of(spark)
    lines = segment.text_lines(spans)
    bars = segment.bars(lines)
    model = segment.page_model(pages, lines, bars, drawings)
    assert {r.page: r.one_column for r in model.collect()} == {1: False, 2: False, 3: False}
    bottoms = segment.column_bottom(pages, lines, images)
    parts = segment.assign_questions(segment.segments(pages, images, lines, bars, model, bottoms)).cache()
    assert [(r.page, r.col, r.kind, r.question) for r in parts.orderBy("ord").collect()] == [(1, 0, "new", 1), (1, 0, "new", 2), (1, 1, "continued", 2), (1, 1, "new", 3), (2, 0, "continued", 3)]
    texts = segment.marked_text(spans, parts, ["doc", "page", "ord", "question"])
    got = {(r.question, r.ord): r.source_text for r in texts.collect()}
    assert got[1, 1] == "Questão 1 UFX 2014\nbody one\n**strong**" and got[2, 3] == "rest of two"
    assert segment.stray_content(lines, images, parts, bottoms).count() == 0
    assert [r.page for r in segment.answer_page(pages, parts).collect()] == [3]
    assert segment.missing_numbers(parts.where("kind = 'new' and number <> 2")).first().missing == [2]


def test_short_words_between_bold_ones(spark):
    words = [("l", i, w, b) for i, (w, b) in enumerate([("Tranças", True), ("e", False), ("de", False), ("resistência", True), ("a", False), ("longer", False), ("x", True)])]
    got = segment.smooth_bold(spark.createDataFrame(words, "line string, ord int, text string, bold boolean"), ["line"]).orderBy("ord").collect()
    assert [r.bold for r in got] == [True, False, False, True, False, False, True]
    words[2] = ("l", 2, "fim", True)
    got = segment.smooth_bold(spark.createDataFrame(words, "line string, ord int, text string, bold boolean"), ["line"]).orderBy("ord").collect()
    assert [r.bold for r in got][:4] == [True] * 4


def test_tiles_become_one_picture(spark):
    tiles = [("d", 1, 0, 0.0, 0.0, 50.0, 20.0), ("d", 1, 1, 0.0, 40.0, 50.0, 60.0), ("d", 1, 2, 0.0, 21.0, 50.0, 40.0), ("d", 1, 3, 90.0, 0.0, 120.0, 20.0)]
    got = segment.merge_tiles(spark.createDataFrame(tiles, schema.IMAGE)).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got) == [(0, 0, 50, 60), (90, 0, 120, 20)]


def test_figures_are_trimmed_where_text_cuts_them(spark):
    from itemforge.operators import segment

    box = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    figures = spark.createDataFrame([("d", 1, k, 100.0, 100.0, 200.0, 200.0) for k in range(2)] + [("d", 2, 0, 100.0, 100.0, 200.0, 200.0), ("d", 3, 0, 100.0, 100.0, 200.0, 200.0)], box)
    lines = [
        ("d", 1, 0, 90.0, 195.0, 210.0, 205.0, "crosses the lower edge"),
        ("d", 1, 1, 90.0, 95.0, 210.0, 105.0, "and the upper edge"),
        ("d", 1, 2, 120.0, 150.0, 180.0, 155.0, "ponto P"),  # a label stays
        ("d", 1, 3, 90.0, 190.0, 210.0, 199.0, "A B"),  # letters of options don't cut
        ("d", 1, 4, 300.0, 95.0, 400.0, 105.0, "beside the figure there"),
        ("d", 2, 0, 110.0, 130.0, 190.0, 140.0, "running text of five words"),
    ]
    got = segment.trim_figures(figures, spark.createDataFrame(lines, box + ", text string")).collect()
    assert {(r.page, r.y0, r.y1) for r in got} == {(1, 106.0, 194.0), (2, 141.0, 200.0), (3, 100.0, 200.0)}


def test_systems_of_equations(spark):
    from itemforge.operators import segment

    box = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    braces = spark.createDataFrame([("d", 1, 0, 10.0, 100.0, 14.0, 140.0), ("d", 1, 1, 10.0, 200.0, 14.0, 240.0), ("d", 1, 2, 10.0, 100.0, 60.0, 140.0)], box)
    pieces = [("d", 1, 5, 0, "x + y ", 20.0, 100.0, 110.0), ("d", 1, 5, 1, "= 2", 60.0, 100.0, 110.0), ("d", 1, 6, 2, "x ≤ 1", 20.0, 120.0, 130.0), ("d", 1, 7, 3, "x = 1", 20.0, 210.0, 220.0)]
    pieces = spark.createDataFrame(pieces, "doc string, page int, line int, ord int, text string, x0 double, y0 double, y1 double")
    assert [(r.ord, r.latex) for r in segment.equation_systems(braces, pieces).collect()] == [(0, "\\begin{cases} x + y = 2 \\\\ x \\le 1 \\end{cases}")]


def test_a_misread_number_makes_no_gap(spark):
    from itemforge.operators import segment

    rows = spark.createDataFrame([("d", n) for n in (1, 3, 987654321)] + [("e", None)], "doc string, number int")
    assert {r.doc: r.missing for r in segment.missing_numbers(rows).collect()} == {"d": [2], "e": []}
    assert [r.number for r in segment.misread_numbers(rows).collect()] == [987654321]
