"""Text items, placed by transformations, to pieces on a page and lines of pieces with bold runs marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrix
from ..functions import text as t
from .ordered import anchored
from .segment import ON

# How near to its first piece's baseline a line's pieces lie, the gap from which pieces are
# parted (or by how much they must overlap), the height of an item that has none, the share of it
# below the baseline, and the most letters of a word that takes its neighbours' weight.
SAME_LINE, GAP, LAP, HEIGHT, BELOW, SHORT = 2.5, 1.5, 1.0, 8.0, 0.25, 3
ALNUM, MARKABLE = "[^A-Za-zÀ-ú0-9]", "[0-9A-Za-zÀ-ú]"


def page_pieces(items: Column, view: Column, middle: Column) -> Column:
    """(base, x0, ord, x1, text, bold, font, height, col), which sort into lines, of a page's items (ord, text, matrix, width, height, font, bold), an array; view: the
    matrix of the page; middle: where its column 1 begins, null if there is none. See text_pieces()."""

    def piece(i: Column) -> Column:
        stretch = F.hypot(i["matrix"]["c"], i["matrix"]["d"])
        height = F.coalesce(F.nullif(i["height"], F.lit(0.0)), F.nullif(stretch, F.lit(0.0)), F.lit(HEIGHT))
        placed = lambda at: F.struct(
            at["y"].alias("base"), at["x"].alias("x0"), i["ord"].alias("ord"), (at["x"] + F.coalesce(i["width"], F.lit(0.0))).alias("x1"), i["text"].alias("text"),
            F.coalesce(i["bold"], F.lit(False)).alias("bold"), i["font"].alias("font"), height.alias("height"), F.when(at["x"] >= middle, 1).otherwise(0).alias("col"),
        )
        return t.once(matrix.placed(view, i["matrix"]["e"], i["matrix"]["f"]), placed)

    return F.transform(F.filter(items, lambda i: F.length(i["text"]) > 0), piece)


def text_pieces(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, ord, col, text, bold, font, x0, x1, base, height) of items (doc, page, ord, text, matrix, width,
    height, font, bold) on pages (doc, page, view, width, one_column), view being the matrix of the page.

    Items without text give none. An item without width is a point; one without height is as high as
    its matrix stretches, or HEIGHT. Column 1 begins at the middle of a page of two columns."""
    p = pages.select(*ON, "view", F.when(~F.col("one_column"), F.col("width") / 2).alias("_middle"))
    rows = items.where(F.length("text") > 0).withColumn("_i", F.array(F.struct("ord", "text", "matrix", "width", "height", "font", "bold"))).select(*ON, "_i").join(p, ON)
    rows = rows.select(*ON, F.inline(page_pieces(F.col("_i"), F.col("view"), F.col("_middle"))))
    return rows.select(*ON, "ord", "col", "text", "bold", "font", "x0", "x1", "base", "height")


def smooth_pieces(pieces: DataFrame, keys: list[str], order: list) -> DataFrame:
    """pieces (text, bold) with a short word between two bold ones made bold, and blanks between
    bold pieces, too; other blanks aren't bold.

    A word that isn't bold can't have made its left neighbour bold, so both neighbours count as they
    were, and no fold is needed. A run of blanks is bold as far as all is that stands to the
    right of its members."""
    row = Window.partitionBy(*keys).orderBy(*order)
    so_far = row.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_word", t.strip(F.col("text")) != "").withColumn("_nth", F.row_number().over(row))
    words = Window.partitionBy(*keys, "_word").orderBy("_nth")
    near = F.coalesce(F.lag("bold").over(words) & F.lead("bold").over(words), F.lit(False))
    short = F.length(F.regexp_replace("text", ALNUM, "")) <= SHORT
    pieces = pieces.withColumn("_bold", F.when(F.col("_word"), F.col("bold") | (short & near)).otherwise(F.col("bold")))
    pieces = pieces.withColumns({"_run": F.count_if("_word").over(so_far), "_next": F.coalesce(F.lead("_bold").over(row), F.lit(False))})
    within = Window.partitionBy(*keys, "_run").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    smooth = F.when(F.col("_word"), F.col("_bold")).otherwise((F.col("_run") > 0) & F.min(F.when(F.col("_word"), F.col("_bold")).otherwise(F.col("_next"))).over(within))
    return pieces.withColumn("bold", smooth).drop("_word", "_nth", "_bold", "_run", "_next")


def smooth_row(pieces: Column) -> Column:
    """smooth_pieces() of the pieces of one line, an array in order; lines without bold pieces stay as they are."""
    word = F.transform(pieces, lambda p: p.withField("word", t.strip(p["text"]) != ""))

    def counted(w: Column) -> Column:
        runs = F.aggregate(w, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + p["word"].cast("int"))))
        return t.bound(smoothed, w=w, runs=runs, words=F.transform(F.filter(w, lambda p: p["word"]), lambda p: p["bold"]))

    def smoothed(v: Column) -> Column:
        run = lambda k: F.get(v["runs"], k)
        near = lambda k: F.coalesce(F.get(v["words"], run(k) - 2) & F.get(v["words"], run(k)), F.lit(False))
        short = lambda p: F.length(F.regexp_replace(p["text"], ALNUM, "")) <= SHORT
        own = F.transform(v["w"], lambda p, k: F.when(p["word"], p["bold"] | (short(p) & near(k))).otherwise(p["bold"]))
        # A blank: what the members of its run have to their right, back to the word before it.
        last = lambda o: F.transform(v["w"], lambda p, k: p.withField("bold", F.when(p["word"], F.get(o, k)).otherwise(F.coalesce(F.get(o, k + 1), F.lit(False)))))
        out = lambda x: F.transform(x, lambda p, k: F.when(p["word"], p).otherwise(p.withField("bold", (run(k) > 0) & F.forall(F.filter(x, lambda q, j: (j <= k) & (run(j) == run(k))), lambda q: q["bold"]))).dropFields("word"))
        return t.once(t.once(own, last), out)

    return F.when(F.exists(pieces, lambda p: p["bold"]), t.once(word, counted)).otherwise(pieces)


def page_lines(pieces: Column, col: int) -> Column:
    """The lines (col, line_no, text, marked, pieces, x0, y0, x1, y1, base) of the pieces of a column, an array of structs that
    begin with base, x0 and ord; see piece_lines()."""
    groups = anchored(F.sort_array(pieces), "base", SAME_LINE)

    def line(g: Column, n: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda p: F.struct(*[p[c].alias(c) for c in ("x0", "base", "ord", "x1", "text", "bold", "font", "height")])))

        def spaced(p: Column) -> Column:
            def piece(x: Column, k: Column) -> Column:
                last = F.when(k > 0, F.get(p, k - 1))
                apart = (x["x0"] - last["x1"] > GAP) | (last["x1"] - x["x0"] > LAP)
                gap = F.when(apart & ~last["text"].endswith(" ") & ~x["text"].startswith(" "), " ").otherwise("")
                return F.struct(F.concat(gap, x["text"]).alias("text"), *[x[c].alias(c) for c in ("bold", "font", "x0", "x1", "base", "height")])

            return F.transform(p, piece)

        def full(p: Column) -> Column:
            text = F.array_join(F.transform(p, lambda x: x["text"]), "")
            marked = F.when(F.exists(p, lambda x: x["bold"]), marked_pieces(p)).otherwise(text)
            base, high = F.array_min(F.transform(p, lambda x: x["base"])), F.array_max(F.transform(p, lambda x: x["height"]))
            x0, x1 = F.array_min(F.transform(p, lambda x: x["x0"])), F.array_max(F.transform(p, lambda x: x["x1"]))
            of = lambda u: F.struct(F.lit(col).alias("col"), (n + 1).alias("line_no"), text.alias("text"), marked.alias("marked"), p.alias("pieces"), x0.alias("x0"), (u["base"] - u["h"]).alias("y0"), x1.alias("x1"), (u["base"] + BELOW * u["h"]).alias("y1"), u["base"].alias("base"))
            return t.bound(of, base=base, h=high)

        return t.once(t.once(t.once(placed, spaced), smooth_row), full)

    return F.transform(groups, line)


def marked_pieces(pieces: Column) -> Column:
    """The text of pieces (text, bold) with bold runs marked, blanks at their ends outside the marks."""
    shown = lambda s: F.when(s["bold"] & s["run"].rlike(MARKABLE), t.bold_marked(s["run"])).otherwise(s["run"])
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("run"), F.lit(False).alias("bold"))

    def step(s: Column, p: Column) -> Column:
        same = s["bold"] == p["bold"]
        return F.struct(F.when(same, s["out"]).otherwise(F.concat(s["out"], shown(s))).alias("out"), F.when(same, F.concat(s["run"], p["text"])).otherwise(p["text"]).alias("run"), p["bold"].alias("bold"))

    return F.aggregate(pieces, start, step, lambda s: F.concat(s["out"], shown(s)))


def piece_lines(pieces: DataFrame) -> DataFrame:
    """(doc, page, col, line_no, text, marked, pieces, x0, y0, x1, y1, base) of text_pieces(): pieces whose baselines lie
    within SAME_LINE of the line's first, from left to right, with a space where they are apart and have none
    (or overlap: the width held a space then). marked has its bold runs marked, blanks at their ends outside.
    Equal places go by baseline, then by ord. A page comes together once."""
    own = F.struct("base", "x0", "ord", "x1", "text", "bold", "font", "height")
    rows = pieces.groupBy(*ON).agg(*[F.collect_list(F.when(F.col("col") == c, own)).alias(f"_{c}") for c in (0, 1)])
    return rows.select(*ON, F.inline(F.concat(page_lines(F.col("_0"), 0), page_lines(F.col("_1"), 1))))
