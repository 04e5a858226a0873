"""Answer keys: pairs of number and letter on a page, keys over several pages; what stands beside
or in a line of text.

What meets by place goes by grid cells: a row meets only rows of its own and adjoining cells. Groups are of a document's
rows throughout, so rows that come dealt out by document aren't dealt out again for a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .segment import ON

# Lines of pairs, a pair, and a number or a letter by itself.
PAIR_LINE, PAIR, NUMBER, LETTER = r"^(\d{1,4}\s+[A-E]\s*)+$", r"(\d{1,4})\s+([A-E])\b", r"^\d{1,4}$", r"^[A-E]$"
# How far baselines of a pair may lie apart and pieces overlap.
SAME_LINE, LAP = 3.0, 2.0
# From where to where a letter stands left of a figure, above its upper edge and how far below.
LEFT, ABOVE, BELOW = (-4.0, 40.0), 14.0, 0.6
#: A pair, and a number or letter by itself; what ranks them.
PAIRED = "struct<number: string, letter: string, line: long, ord: long, k: int>"
ALONE = "struct<text: string, line: long, ord: long, base: double, x0: double, x1: double>"
PAIR_RANK, NEAR_RANK = "struct<line: long, ord: long, k: int>", "struct<line: long, ord: long, x0: double, letter: string>"
#: Sides of grid cells, in points.
CELL_X, CELL_Y = LEFT[1] - LEFT[0], 50.0


def _cell(at: Column, side: float) -> Column:
    return F.floor(at / side)


def page_answers(pieces: DataFrame) -> DataFrame:
    """(doc, page, number, letter), from the pieces of lines (doc, page, line, ord, text, base, x0, x1).

    In a line of pairs each piece's pairs count, of repeats the last; other lines and the pieces of such lines may be a
    number or a letter alone: a number without a pair takes the nearest letter to its right on its baseline, of
    repeats the first. number is two digits at least. A page without pairs gives no rows."""
    p = pieces.select(*ON, "line", F.struct("ord", t.strip(F.col("text")).alias("text"), "base", "x0", "x1").alias("p"))
    lines = p.groupBy(*ON, "line").agg(F.sort_array(F.collect_list("p")).alias("_p"), F.min("p.base").alias("base"), F.min("p.x0").alias("x0"), F.max("p.x1").alias("x1"))
    lines = lines.withColumn("_line", t.strip(F.array_join(F.transform("_p", lambda x: x["text"]), " ")))
    lines = lines.withColumn("_paired", F.col("_line").rlike(PAIR_LINE))
    pair = lambda m, x, k: F.struct(t.two_digits(F.regexp_extract(m, PAIR, 1).cast("int")).alias("number"), F.regexp_extract(m, PAIR, 2).alias("letter"), F.col("line").alias("line"), x["ord"].alias("ord"), k.alias("k"))
    inline = F.flatten(F.transform("_p", lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(PAIR), F.lit(0)), lambda m, k: pair(m, x, k))))
    whole = F.array(F.struct(F.lit(0).alias("ord"), F.col("_line").alias("text"), "base", "x0", "x1").cast(p.schema["p"].dataType.simpleString()))
    alone = F.filter(F.when(F.col("_paired"), F.col("_p")).otherwise(whole), lambda x: x["text"].rlike(f"{NUMBER}|{LETTER}"))
    # Pairs, numbers and letters stand in one column each, in the grid cell where they meet: a number is in three.
    none = {"pair": F.lit(None).cast(PAIRED), "number": F.lit(None).cast(ALONE), "letter": F.lit(None).cast(ALONE)}
    entry = lambda cell, name, x: F.struct(cell.cast("long").alias("cell"), *[(x.cast(PAIRED if k == "pair" else ALONE) if k == name else none[k]).alias(k) for k in none])
    own = lambda x: F.struct(x["text"].alias("text"), F.col("line").alias("line"), x["ord"].alias("ord"), x["base"].alias("base"), x["x0"].alias("x0"), x["x1"].alias("x1"))
    cell = lambda x: _cell(x["base"], SAME_LINE)
    pairs = F.when(F.col("_paired"), F.transform(inline, lambda x: entry(F.lit(None), "pair", x)))
    letters = F.transform(F.filter(alone, lambda x: x["text"].rlike(LETTER)), lambda x: entry(cell(x), "letter", own(x)))
    numbers = F.flatten(F.transform(F.filter(alone, lambda x: x["text"].rlike(NUMBER)), lambda x: F.transform(F.sequence(cell(x) - 1, cell(x) + 1), lambda c: entry(c, "number", own(x)))))
    entries = lines.select(*ON, F.inline(F.concat(F.coalesce(pairs, F.array().cast(lines.select(letters.alias("e")).schema["e"].dataType.simpleString())), letters, numbers)))
    met = entries.groupBy(*ON, "cell").agg(*[F.collect_list(c).alias(c) for c in none])

    def nearest(n: Column) -> Column:
        beside = F.filter("letter", lambda x: (F.abs(x["base"] - n["base"]) < SAME_LINE) & (x["x0"] > n["x1"] - LAP))
        near = F.array_min(F.transform(beside, lambda x: F.struct(x["x0"].alias("x0"), x["text"].alias("letter"))))
        return F.struct(t.two_digits(n["text"].cast("int")).alias("number"), near["letter"].alias("letter"), F.lit(None).cast(PAIR_RANK).alias("pair"), F.struct(n["line"].alias("line"), n["ord"].alias("ord"), near["x0"].alias("x0"), near["letter"].alias("letter")).alias("near"))

    paired = F.transform("pair", lambda x: F.struct(x["number"].alias("number"), x["letter"].alias("letter"), F.struct(x["line"].alias("line"), x["ord"].alias("ord"), x["k"].alias("k")).alias("pair"), F.lit(None).cast(NEAR_RANK).alias("near")))
    found = met.select(*ON, F.inline(F.concat(paired, F.filter(F.transform("number", nearest), lambda x: x["letter"].isNotNull()))))
    best = F.coalesce(F.max_by("letter", F.col("pair")), F.min_by("letter", F.col("near")))
    return found.groupBy(*ON, "number").agg(best.alias("letter"))


def key_pages(pages: DataFrame, segments_: DataFrame) -> DataFrame:
    """(doc, page, turn): where to look for a document's key, in this order: the pages without
    segments after the last page with some, then that page."""
    held = segments_.select(*ON).distinct()
    last = held.groupBy("doc").agg(F.max("page").alias("_last"))
    rows = pages.select(*ON).distinct().join(last, "doc").where(F.col("page") >= F.col("_last"))
    return rows.select(*ON, F.when(F.col("page") == F.col("_last"), None).otherwise(F.col("page")).alias("turn")).select(*ON, F.coalesce("turn", F.lit(2**31 - 1)).cast("long").alias("turn"))


def answer_keys(questions: DataFrame, turns: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys (doc, number, letter) of the documents whose questions (doc, number) are all answered,
    and (doc, n_questions, n_read, complete) for each.

    Pages are read in turn until every question is answered, and what a later page says replaces what an earlier
    one said. Where the reading stops follows from when each question is first answered, so it needs no
    walk: the latest of these turns. turns: key_pages(); answers: page_answers()."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    of_doc = turns.groupBy("doc").agg(F.collect_list(F.struct("page", "turn")).alias("_t"))
    read = answers.join(of_doc, "doc").select("doc", "page", "number", "letter", F.explode(F.filter("_t", lambda x: x["page"] == F.col("page"))).alias("t"))
    read = read.select("doc", "number", F.struct(F.col("t.turn").alias("turn"), "letter").alias("read"), F.lit(False).alias("asked"))
    asked = questions.select("doc", t.two_digits(F.col("number")).alias("number"), none("read", read.schema["read"].dataType.simpleString()), F.lit(True).alias("asked"))
    # Dealt out by document once: what follows groups a document's rows.
    rows = read.unionByName(asked).repartition("doc").groupBy("doc", "number").agg(F.max("asked").alias("asked"), F.min("read.turn").alias("first"), F.collect_list("read").alias("_r"))
    w, first = Window.partitionBy("doc"), F.when(F.col("asked"), F.col("first"))
    rows = rows.withColumns({"n_questions": F.count_if("asked").over(w), "_n": F.count(first).over(w), "_stop": F.max(first).over(w)}).where("n_questions > 0")
    rows = rows.withColumn("complete", F.col("_n") == F.col("n_questions"))
    counted = F.filter("_r", lambda x: ~F.col("complete") | (x["turn"] <= F.col("_stop")))
    rows = rows.select("doc", "number", "n_questions", "complete", F.array_max(counted)["letter"].alias("letter"))
    summary = rows.groupBy("doc", "n_questions", "complete").agg(F.count("letter").alias("n_read")).select("doc", "n_questions", "n_read", "complete")
    return rows.where("complete and letter is not null").select("doc", "number", "letter"), summary


def figure_letters(figures: DataFrame, pieces: DataFrame, keys: list[str] = ON) -> DataFrame:
    """figures (doc, page, ord, x0, y0, x1, y1) with letter, that of the nearest piece (doc, page, text, x0, x1, base,
    height) that is a letter, alone or before a bracket or stop, left of the figure's upper corner; null
    without one. Distances are sums of those along either axis; ties go to the first letter. keys (of a page, or of a
    part of one) bound what meets."""
    mark = F.regexp_replace(t.strip(F.col("text")), r"[).]$", "")
    centre = F.col("base") - 0.4 * F.col("height")
    letters = pieces.where(mark.rlike(LETTER)).select(*keys, mark.alias("letter"), F.col("x1").alias("_x"), centre.alias("_y"))
    letters = letters.withColumns({"cx": _cell(F.col("_x"), CELL_X), "cy": _cell(F.col("_y"), CELL_Y)})
    low = F.col("y0") + BELOW * (F.col("y1") - F.col("y0"))
    f = figures.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0") - LEFT[1], CELL_X), _cell(F.col("x0") - LEFT[0], CELL_X))))
    f = f.withColumn("cy", F.explode(F.sequence(_cell(F.col("y0") - ABOVE, CELL_Y), _cell(F.greatest(low, F.col("y0")), CELL_Y))))
    dx = F.col("x0") - F.col("_x")
    near = f.join(letters, [*keys, "cx", "cy"]).where(dx.between(*LEFT) & (F.col("_y") >= F.col("y0") - ABOVE) & (F.col("_y") <= low))
    found = near.groupBy(*keys, "ord").agg(F.min_by("letter", F.struct((F.abs(dx) + F.abs(F.col("_y") - F.col("y0"))).alias("d"), "letter")).alias("letter"))
    return figures.join(found, [*keys, "ord"], "left")


def letter_beside(figure: Column, piece: Column) -> Column:
    """(d, letter): how far a piece (text, x1, base, height) that is a letter lies from a figure's upper corner; null where it
    isn't one, or too far. See figure_letters()."""
    mark = F.regexp_replace(t.strip(piece["text"]), r"[).]$", "")
    dx, y = figure["x0"] - piece["x1"], piece["base"] - 0.4 * piece["height"]
    near = dx.between(*LEFT) & (y >= figure["y0"] - ABOVE) & (y <= figure["y0"] + BELOW * (figure["y1"] - figure["y0"]))
    return F.when(near, t.once(mark, lambda m: F.when(m.rlike(LETTER), F.struct((F.abs(dx) + F.abs(y - figure["y0"])).alias("d"), m.alias("letter")))))


def shared_height(mark: Column, line: Column) -> Column:
    return F.least(mark["y1"], line["y1"]) - F.greatest(mark["y0"], line["y0"])


def hosts(mark: Column, line: Column) -> Column:
    """Whether a line may host a mark; see host_lines()."""
    shared, centre = shared_height(mark, line), (line["y0"] + line["y1"]) / 2
    return (shared >= 0.5 * (line["y1"] - line["y0"])) | ((shared > 0) & (centre > mark["y0"]) & (centre < mark["y1"]))


def host_lines(marks: DataFrame, lines: DataFrame, side: float = 20.0, keys: list[str] = ON) -> DataFrame:
    """(doc, page, ord, line): the line of text in which a formula stands, null if it has one of its own. A line
    hosts what covers half its height, or its centre; of several that with the largest part of it, then
    the first. marks (doc, page, ord, y0, y1) and lines (doc, page, line, y0, y1) meet by cells of `side` points."""
    cells = lambda a, b: F.explode(F.sequence(_cell(F.col(a), side), _cell(F.greatest(F.col(a), F.col(b)), side)))
    l = lines.select(*keys, "line", F.col("y0").alias("_y0"), F.col("y1").alias("_y1")).withColumn("cell", cells("_y0", "_y1"))
    m = marks.withColumn("cell", cells("y0", "y1"))
    mark, line = F.struct("y0", "y1"), F.struct(F.col("_y0").alias("y0"), F.col("_y1").alias("y1"))
    shared = shared_height(mark, line)
    met = m.join(l, [*keys, "cell"]).where(hosts(mark, line)).groupBy(*keys, "ord").agg(F.min_by("line", F.struct((-shared).alias("s"), "line")).alias("line"))
    return marks.select(*keys, "ord").join(met, [*keys, "ord"], "left")


def placed_marks(lines: Column, marks: Column) -> Column:
    """lines (an array of texts) with marks, structs (at, text) in their order, each as a line of its own before the
    line that had number `at` (from 0) in the unmarked text, at the end where there is none. Each line takes its own
    marks, so those put before it don't move it."""
    at = lambda m: F.least(F.greatest(m["at"], F.lit(0)), F.size(lines))
    ours = lambda k: F.transform(F.filter(marks, lambda m: at(m) == k), lambda m: m["text"])
    put = F.flatten(F.transform(lines, lambda x, k: F.concat(ours(k), F.array(x))))
    return F.concat(F.coalesce(put, F.array().cast("array<string>")), ours(F.size(lines)))


def numbered_marks(text: Column, prefix: Column, pattern: str = r"⟦FÓRMULA #\d+⟧") -> Column:
    """text with its marks numbered anew from 1, in the order in which they stand: `prefix`1 and so on."""
    parts = F.split(text, pattern)
    name = lambda k: F.concat(F.lit("⟦FÓRMULA "), prefix, k.cast("string"), F.lit("⟧"))
    return t.once(parts, lambda p: F.array_join(F.transform(p, lambda x, k: F.when(k == 0, x).otherwise(F.concat(name(k), x))), ""))
