import random
import re

from itemforge.functions import text as t
from itemforge.operators import answers, layout
from pyspark.sql import functions as F

PIECES = "doc long, page int, line int, ord int, text string, base double, x0 double, x1 double"


def lean(s):
    """Takes one pair of braces away at a time, from the left, and starts over behind it."""
    at = 0
    while (i := s.find("{\\", at)) >= 0:
        at = i + 1
        if re.search(t.ARGUMENT, s[:i]):
            continue
        depth = [0]
        for c in s[i:]:
            depth.append(depth[-1] + {"{": 1, "}": -1}.get(c, 0))
        if 0 not in depth[1:]:
            return s
        end = i + depth.index(0, 1) - 1
        inner, group = s[i + 1 : end], "x"
        while group != inner:  # groups shrink to nothing, innermost first
            group, inner = inner, re.sub(r"\{[^{}]*\}", "\0", inner)
        if re.fullmatch(r"\\[a-zA-Z]+\0*", inner):
            s = s[:i] + s[i + 1 : end] + s[end + 1 :]
            at = i
    return s


def test_lean_braces_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["{", "}", "{\\a", "\\frac", "\\b", "}", "^", "_", "x", " ", "{\\frac{p}{q}}", "{{\\c}}", "\\vec  ", "\\{"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", "{\\", "{", "\\", "{\\a{b}{c}d}", "^{\\a}{\\b}"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(texts)] + [(-1, None)], "i int, s string").select("i", t.lean_braces("s").alias("s")).collect()
    by = {r.i: r.s for r in got}
    assert by.pop(-1) is None
    assert {i: (s, by[i]) for i, s in enumerate(texts) if by[i] != lean(s)} == {}


def test_pairs_on_a_page(spark):
    rows = [
        (1, 1, 0, 0, "01 A  51 C", 10, 0, 50), (1, 1, 0, 1, "2", 10, 60, 66), (1, 1, 0, 2, "D", 10, 70, 76),  # a line of pairs, one in two pieces
        (1, 1, 1, 0, "7", 40, 0, 8), (1, 1, 2, 0, "B", 42.5, 30, 36), (1, 1, 3, 0, "E", 38, 20, 26), (1, 1, 4, 0, "A", 43, 10, 16),  # the nearest on the baseline
        (1, 1, 5, 0, "8", 59, 0, 8), (1, 1, 6, 0, "C", 61, 30, 36),  # over the edge of a cell
        (1, 1, 7, 0, "1", 80, 0, 8), (1, 1, 8, 0, "E", 80, 20, 26),  # known from a pair
        (1, 1, 9, 0, "9 text", 100, 0, 8), (1, 1, 10, 0, "9", 120, 40, 48), (1, 1, 11, 0, "A", 120, 0, 6), (1, 1, 12, 0, None, 120, 50, 60),  # nothing to the right
        (1, 2, 0, 0, "01 B 01 C", 10, 0, 50),  # another page, the last of repeats
    ]
    df = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], PIECES)
    got = {(r.page, r.number): r.letter for r in answers.page_answers(df).collect()}
    assert got == {(1, "01"): "A", (1, "51"): "C", (1, "02"): "D", (1, "07"): "E", (1, "08"): "C", (2, "01"): "C"}
    assert answers.page_answers(df.limit(0)).count() == 0


def test_keys_stop_when_all_is_answered(spark):
    questions = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 5)], "doc long, number int")
    pages = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in (1, 2, 3, 4)], "doc long, page int")
    held = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in (1, 2)], "doc long, page int")
    turns = answers.key_pages(pages, held)
    assert sorted((r.page, r.turn) for r in turns.where("doc = 1").collect()) == [(2, 2**31 - 1), (3, 3), (4, 4)]
    read = [(1, 3, "01", "A"), (1, 3, "02", "B"), (1, 4, "01", "C"), (2, 3, "01", "A"), (2, 4, "01", "D"), (2, 2, "02", "E"), (3, 3, "01", "A")]
    key, totals = answers.answer_keys(questions, turns, spark.createDataFrame(read, "doc long, page int, number string, letter string"))
    assert sorted(map(tuple, key.collect())) == [(1, "01", "A"), (1, "02", "B"), (2, "01", "D"), (2, "02", "E")]
    assert sorted(map(tuple, totals.collect())) == [(1, 2, 2, True), (2, 2, 2, True), (3, 1, 1, False)]


def test_marks(spark):
    row = spark.sql("select array('a', 'b') l, cast(array(struct(1, 'x'), struct(1, 'y'), struct(-3, 'first'), struct(9, 'end')) as array<struct<at: int, text: string>>) m, array_remove(array(''), '') no")
    put = row.select(answers.placed_marks(F.col("l"), F.col("m")).alias("p"), answers.placed_marks(F.col("no"), F.col("m")).alias("q")).first()
    assert put.p == ["first", "a", "x", "y", "b", "end"] and put.q == ["x", "y", "first", "end"]
    text = spark.sql("select '⟦FÓRMULA #4⟧ and ⟦FÓRMULA #4⟧, ⟦FÓRMULA #12⟧' t, 'none' u")
    assert text.select(answers.numbered_marks(F.col("t"), F.lit("Q7_f"))).first()[0] == "⟦FÓRMULA Q7_f1⟧ and ⟦FÓRMULA Q7_f2⟧, ⟦FÓRMULA Q7_f3⟧"
    assert text.select(answers.numbered_marks(F.col("u"), F.lit("Q"))).first()[0] == "none"


def page_of(spark, spans, images=(), drawings=()):
    s = spark.createDataFrame([(d, p, y, x0, x1, y - 10, y, t) for d, p, y, x0, x1, t in spans], "doc long, page int, base double, x0 double, x1 double, y0 double, y1 double, text string")
    pages = s.select("doc", "page").distinct().select("doc", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    box = "doc long, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    i, d = spark.createDataFrame(list(images), box), spark.createDataFrame(list(drawings), box + ", fill array<double>")
    return layout.page_layout(pages, s, i, d, pages.select("doc", "page", F.lit(770.0).alias("bottom")))


def test_guards_of_a_layout(spark):
    bar = lambda p, y=100.0, x=40.0: (1, p, y, x, x + 60, "Questão 3")
    across = lambda p, k, y: [(1, p, y + 20 * i, 40.0, 560.0, "a line across the page") for i in range(k)]
    parted = lambda p, k, y, text="three plain words": [(1, p, y + 20 * i, *x, text) for i in range(k) for x in ((40.0, 280.0), (320.0, 560.0))]
    spans = [bar(1), *across(1, 3, 200.0)]  # text across
    spans += [*parted(2, 3, 200.0)]  # no bar, but a gutter
    spans += [*parted(3, 3, 200.0, "too short")]  # like the page before
    spans += [bar(4), (1, 4, 100.0, 500.0, 560.0, "UF 2020"), *parted(4, 4, 200.0)]  # its bar spans the page, so no gutter counts
    spans += [bar(5), bar(5, 100.0, 320.0), *parted(5, 2, 200.0)]  # a bar in the right half
    spans += [bar(6), *across(6, 1, 200.0)]  # two columns by the text, but they don't hold the line
    model, parts = page_of(spark, spans)
    got = {r.page: (r.one_column, r.rule) for r in model.collect()}
    assert got == {1: (True, "crossing"), 2: (False, "gutter"), 3: (False, "page before"), 4: (True, "votes"), 5: (False, "right bar"), 6: (True, "covers")}
    assert sorted((r.page, r.col, r.kind) for r in parts.collect() if r.page in (1, 5)) == [(1, 0, "new"), (5, 0, "new"), (5, 1, "new")]
