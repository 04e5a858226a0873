"""From page primitives to questions: columns, bars, segments, figures and marked text.

Inputs are tables of pages, text lines or spans, and images (see schema.py). All joins
are on (doc, page); folds run over one page's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import spatial
from .ordered import anchor_groups, bands, carry_down, majority

# Names of stages, the top margin and the least side of a figure in points, the
# least sides of a wide and low one (a table of one row), how bars and bank names read, and how bold fonts are named.
STAGES = ("Fixação", "Treinamento", "Aprofundamento", "Desafios")
TOP, FIGURE = 30.0, 30.0
WIDE, LOW = 80.0, 12.0
BAR = r"^\s*Quest[aã]o\s*(\d[\d ]*)"
BANK = r"^[A-ZÀ-Ú0-9][A-Za-zÀ-ú0-9ª.\-/() ]*\s(19|20)\d{2}(/\d+)?$"
BOLD_FONT = r"(?i)bold|black|heavy|semibold|demibold|extrabold|,b$"
ON = ["doc", "page"]


def _box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def text_lines(spans: DataFrame) -> DataFrame:
    """Lines of the page with their text and bounding box."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return spans.groupBy("doc", "page", "block", "line").agg(whole.alias("text"), *_box())


def is_figure(box: Column) -> Column:
    """Whether a box (a struct of x0, y0, x1, y1) is large enough for a figure, and below the top."""
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return (((wide >= FIGURE) & (high >= FIGURE)) | ((wide >= WIDE) & (high >= LOW))) & (box["y0"] > TOP)


def figures(images: DataFrame) -> DataFrame:
    return images.where(is_figure(F.struct("x0", "y0", "x1", "y1")))


def column_split(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, page, width, height, middle): the middle of the first thin tall rule, else of the page."""
    rule = images.join(pages, ON).where((F.col("x1") - F.col("x0") < 3) & (F.col("y1") - F.col("y0") > F.col("height") * 0.6))
    rule = rule.groupBy(*ON).agg(F.min_by((F.col("x0") + F.col("x1")) / 2, "ord").alias("_m"))
    return pages.join(rule, ON, "left").withColumn("middle", F.coalesce("_m", F.col("width") / 2)).drop("_m")


def column_bottom(pages: DataFrame, lines: DataFrame, images: DataFrame, footer: str = "Plataforma") -> DataFrame:
    """(doc, page, bottom): a wide thin rule near the end, else the footer's text, else a margin."""
    rule = images.join(pages, ON).where((F.col("y1") - F.col("y0") < 4) & (F.col("x1") - F.col("x0") > F.col("width") * 0.8) & (F.col("y0") > F.col("height") * 0.8))
    rule = rule.groupBy(*ON).agg(F.min("y0").alias("_rule"))
    foot = lines.join(pages, ON).where((F.col("y0") > F.col("height") * 0.85) & F.col("text").rlike(footer)).groupBy(*ON).agg(F.min(F.col("y0") - 8).alias("_foot"))
    found = pages.join(rule, ON, "left").join(foot, ON, "left")
    return found.select(*ON, F.coalesce("_rule", "_foot", F.col("height") - 30).alias("bottom"))


def bars(lines: DataFrame) -> DataFrame:
    """(doc, page, number, x0, y0, x1, y1, text): the bars with which questions begin."""
    found = lines.where(F.col("text").rlike(BAR) & (F.col("y0") > TOP))
    number = F.replace(F.regexp_extract("text", BAR, 1), F.lit(" "), F.lit("")).cast("int")
    return found.select(*ON, number.alias("number"), "x0", "y0", "x1", "y1", "text")


def crossing_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, crossing): lines of text across the middle; three mean one column."""
    wide = lines.join(pages, ON).where((F.length(t.strip(F.col("text"))) >= 8) & (F.col("x0") < F.col("width") / 2 - 15) & (F.col("x1") > F.col("width") / 2 + 15))
    return wide.groupBy(*ON).agg(F.count(F.lit(1)).alias("crossing"))


def box_behind(bar: Column, box: Column) -> Column:
    """Whether a coloured box (x0, y0, x1, y1, fill) lies behind a bar."""
    y = (bar["y0"] + bar["y1"]) / 2
    behind = y.between(box["y0"] - 1, box["y1"] + 1) & (bar["x0"] + 2).between(box["x0"] - 1, box["x1"]) & (box["y1"] - box["y0"] < 40)
    return behind & F.coalesce(F.array_max(box["fill"]) - F.array_min(box["fill"]) > 0.1, F.lit(False))


def bar_ends(bars_: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc, page, number, y0, bar_end): the right end of the coloured box behind a bar."""
    d = drawings.select(*ON, F.struct("x0", "y0", "x1", "y1", "fill").alias("_d"))
    behind = box_behind(F.struct("x0", "y0", "y1"), F.col("_d"))
    return bars_.join(d, ON).where(behind).groupBy(*ON, "number", "y0").agg(F.max("_d.x1").alias("bar_end"))


def page_model(pages: DataFrame, lines: DataFrame, bars_: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc, page, one_column): a bar right of the middle proves two columns; else the
    bars vote by how far they reach; else text across the middle decides; a page
    without bars is like the one before."""
    ends = bar_ends(bars_, drawings)
    votes = bars_.join(ends, [*ON, "number", "y0"], "left").join(pages, ON)
    middle = F.col("width") / 2
    vote = F.when(F.col("bar_end").isNotNull(), (F.col("x0") < middle - 30) & (F.col("bar_end") > middle + 30))
    right = votes.groupBy(*ON).agg(F.max(F.col("x0") >= middle).alias("right"))
    voted = majority(votes, ON, vote)
    crossing = crossing_lines(lines, pages)
    known = pages.join(right, ON, "left").join(voted, ON, "left").join(crossing, ON, "left")
    own = F.when(F.col("right").isNull(), None).when(F.col("right"), False).when(F.col("votes") > 0, F.col("carried")).otherwise(F.coalesce("crossing", F.lit(0)) >= 3)
    known = carry_down(known.withColumn("_own", own), ["doc"], ["page"], F.col("_own"), "_seen")
    return known.select(*ON, F.coalesce("_seen", F.lit(False)).alias("one_column"))


def segments(pages: DataFrame, images: DataFrame, lines: DataFrame, bars_: DataFrame, model: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(doc, page, col, kind, number, x0, y0, x1, y1): in each column one segment from
    each bar to the next, and one before the first bar if something stands there."""
    layout = column_split(pages, images).join(model, ON).join(bottoms, ON)
    columns = F.when(F.col("one_column"), F.array(F.struct(F.lit(0).alias("col"), F.lit(0.0).alias("cx0"), F.col("width").alias("cx1"))))
    columns = columns.otherwise(F.array(F.struct(F.lit(0).alias("col"), F.lit(0.0).alias("cx0"), F.col("middle").alias("cx1")), F.struct(F.lit(1).alias("col"), F.col("middle").alias("cx0"), F.col("width").alias("cx1"))))
    cols = layout.select(*ON, "bottom", F.inline(columns))
    placed = bars_.join(layout.select(*ON, "one_column", "middle"), ON)
    placed = placed.withColumn("col", F.when(F.col("one_column") | (F.col("x0") < F.col("middle")), 0).otherwise(1)).select(*ON, "col", "number", F.col("y0").alias("bar_y"))
    following = F.lead("bar_y").over(Window.partitionBy(*ON, "col").orderBy("bar_y"))
    new = placed.withColumn("_next", following).join(cols, [*ON, "col"])
    new = new.select(*ON, "col", F.lit("new").alias("kind"), "number", (F.col("cx0") + 2).alias("x0"), (F.col("bar_y") - 2).alias("y0"), (F.col("cx1") - 2).alias("x1"), (F.coalesce("_next", "bottom") - 2).alias("y1"))
    first = placed.groupBy(*ON, "col").agg(F.min("bar_y").alias("_first"))
    top = cols.join(first, [*ON, "col"], "left")
    top = top.select(*ON, "col", F.lit("continued").alias("kind"), F.lit(None).cast("int").alias("number"), (F.col("cx0") + 2).alias("x0"), F.lit(TOP).alias("y0"), (F.col("cx1") - 2).alias("x1"), (F.coalesce("_first", "bottom") - 2).alias("y1"))
    top = top.where(F.col("y1") - F.col("y0") > 6)
    body = t.strip(F.col("text"))
    content = lines.where((F.length(body) >= 2) & ~body.isin(*STAGES)).select(*ON, ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    shown = figures(images).select(*ON, ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    held = spatial.inside(content.unionByName(shown), top.select(*ON, "col", "x0", "y0", "x1", "y1"), ON, F.col("px"), F.col("py")).select(*ON, "col").distinct()
    return new.unionByName(top.join(held, [*ON, "col"], "left_semi"))


def assign_questions(segments_: DataFrame) -> DataFrame:
    """Adds question, the number that was open when the segment began (null before the
    first), and ord, its place in reading order."""
    order = ["page", "col", "y0"]
    out = carry_down(segments_, ["doc"], order, F.col("number"), "question")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def marked_text(spans: DataFrame, segments_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_text): the spans of a segment as lines, bold runs marked, centred
    lines flagged. keys tell segments apart. The first line of a new segment, its
    bar, stays plain."""
    spans = spans.where(F.length(t.strip(F.col("text"))) > 0)
    boxes = segments_.select(*dict.fromkeys([*ON, *keys]), "kind", "x0", "y0", "x1", "y1")
    s = spans.select(*ON, "text", "font", "flags", "base", *[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    own = spatial.inside(s, boxes, ON, (F.col("sx0") + F.col("sx1")) / 2, (F.col("sy0") + F.col("sy1")) / 2)
    own = own.withColumn("bold", (F.col("flags").bitwiseAND(16) != 0) | F.col("font").rlike(BOLD_FONT))
    own = own.withColumn("region_mid", (F.col("x0") + F.col("x1")) / 2).select(*keys, "kind", "base", "sx0", "sx1", "text", "bold", "region_mid")
    rows = anchor_groups(own, keys, "base", ["base", "sx0"], 2.5, "line_no")
    by_x = Window.partitionBy(*keys, "line_no").orderBy("sx0", "text")
    end = F.lag("sx1").over(by_x)
    spaced = (F.col("sx0") - end > 1.5) | (end - F.col("sx0") > 1)
    gap = F.when(spaced & ~F.lag("text").over(by_x).endswith(" ") & ~F.col("text").startswith(" "), " ").otherwise("")
    rows = rows.withColumn("piece", F.concat(gap, "text"))
    change = F.coalesce((F.lag("bold").over(by_x) != F.col("bold")).cast("int"), F.lit(0))
    rows = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    run = rows.groupBy(*keys, "kind", "region_mid", "line_no", "run", "bold").agg(in_order("piece", "sx0").alias("plain"), F.min("sx0").alias("sx0"), F.max("sx1").alias("sx1"))
    run = run.withColumn("marked", F.when(F.col("bold") & F.col("plain").rlike("[0-9A-Za-zÀ-ú]"), t.bold_marked(F.col("plain"))).otherwise(F.col("plain")))
    line = run.groupBy(*keys, "kind", "region_mid", "line_no").agg(in_order("plain", "run").alias("plain"), in_order("marked", "run").alias("marked"), F.min("sx0").alias("lx0"), F.max("sx1").alias("lx1"))
    is_bar = (F.col("kind") == "new") & (F.col("line_no") == 1)
    whole = Window.partitionBy(*keys)
    left, right = F.min(F.when(~is_bar, F.col("lx0"))).over(whole), F.max(F.when(~is_bar, F.col("lx1"))).over(whole)
    line = line.withColumn("_l", F.coalesce(left, "lx0")).withColumn("_r", F.coalesce(right, "lx1"))
    width, mid = F.greatest(F.lit(1.0), F.col("_r") - F.col("_l")), (F.col("lx0") + F.col("lx1")) / 2
    near = lambda c: F.abs(mid - c) < 0.04 * width
    centred = ~is_bar & (F.length(t.strip(F.col("plain"))) >= 3) & (F.col("lx1") - F.col("lx0") < 0.8 * width) & (F.col("lx0") - F.col("_l") > 0.06 * width) & (near((F.col("_l") + F.col("_r")) / 2) | near(F.col("region_mid")))
    shown = F.concat(F.when(centred, t.CENTRED_MARK).otherwise(""), F.when(is_bar, F.col("plain")).otherwise(F.col("marked")))
    out = line.withColumn("shown", shown).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "shown"))).alias("_x"))
    return out.select(*keys, t.strip(F.array_join(F.transform("_x", lambda x: x["shown"]), "\n")).alias("source_text"))


def centred_figures(figures_: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """figures_ with band and centred: figures side by side count as one. extents: keys,
    left, right (of the text) and region_mid."""
    banded = bands(figures_, keys)
    w = Window.partitionBy(*keys, "band")
    banded = banded.withColumn("_x0", F.min("x0").over(w)).withColumn("_x1", F.max("x1").over(w)).join(extents, keys)
    return banded.withColumn("centred", is_centred(*[F.col(c) for c in ("_x0", "_x1", "left", "right", "region_mid")])).drop("_x0", "_x1", "left", "right", "region_mid")


def is_centred(x0: Column, x1: Column, left: Column, right: Column, region_mid: Column) -> Column:
    """Whether what reaches from x0 to x1 is centred in the text (left to right) or its region, or as wide as the text."""
    width, mid = F.greatest(F.lit(1.0), right - left), (x0 + x1) / 2
    return (x1 - x0 >= 0.85 * width) | (F.abs(mid - (left + right) / 2) < 0.05 * width) | (F.abs(mid - region_mid) < 0.05 * width)


def number_figures(figures_: DataFrame, question: str = "question") -> DataFrame:
    """Names figures `Qnn_figk` in the order of part, band and x."""
    k = F.row_number().over(Window.partitionBy("doc", question).orderBy("part", "band", "x0"))
    return figures_.withColumn("name", F.concat(F.lit("Q"), t.two_digits(F.col(question)), F.lit("_fig"), k.cast("string")))


def stray_content(lines: DataFrame, images: DataFrame, segments_: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1, what): text and figures outside all segments."""
    body = t.strip(F.col("text"))
    texts = lines.join(bottoms, ON).where((F.length(body) >= 2) & ~body.isin(*STAGES) & ~F.col("text").rlike(BAR) & (F.col("y0") >= TOP) & (F.col("y0") < F.col("bottom") - 2))
    shown = figures(images).join(bottoms, ON).where(F.col("y0") < F.col("bottom"))
    items = texts.select(*ON, "x0", "y0", "x1", "y1", F.substring(body, 1, 80).alias("what")).unionByName(shown.select(*ON, "x0", "y0", "x1", "y1", F.lit("[imagem]").alias("what")))
    return spatial.outside_all(items, segments_, ON)


def stacked_offsets(parts: DataFrame, keys: list[str], order: list, height: str = "height", gap: float = 6) -> DataFrame:
    """Where each part of a question begins when they are stacked with a gap."""
    before = F.sum(F.col(height) + gap).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("offset", F.coalesce(before, F.lit(0.0)))


def missing_numbers(questions: DataFrame, key: str = "doc", number: str = "number", most: int = 100_000) -> DataFrame:
    """(key, missing): numbers from 1 to the largest that are not there. A number over
    `most` is misread and counts for nothing; see misread_numbers()."""
    real = F.when(F.col(number) <= most, F.col(number))
    per = questions.groupBy(key).agg(F.max(real).alias("_max"), F.collect_set(real).alias("_have"))
    every = F.when(F.col("_max") >= 1, F.sequence(F.lit(1), F.col("_max").cast("int"))).otherwise(F.array())
    return per.select(key, F.array_except(every, F.col("_have").cast("array<int>")).alias("missing"))


def misread_numbers(questions: DataFrame, key: str = "doc", number: str = "number", most: int = 100_000) -> DataFrame:
    """(key, number): numbers larger than any list has."""
    return questions.where(F.col(number) > most).select(key, number).distinct()


def repeated_numbers(questions: DataFrame, key: str = "doc", number: str = "number") -> DataFrame:
    return questions.groupBy(key, number).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def answer_page(pages: DataFrame, segments_: DataFrame) -> DataFrame:
    """(doc, page): the first page without segments after the last one with some."""
    last = segments_.groupBy("doc").agg(F.max("page").alias("_last"))
    empty = pages.join(segments_.select(*ON).distinct(), ON, "left_anti").join(last, "doc")
    return empty.where("page > _last").groupBy("doc").agg(F.min("page").alias("page"))


def smooth_bold(words: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """words (keys, ord, text, bold) with short words between two bold ones made bold. The
    left one may itself have been made so, hence a fold over each line's words."""
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "text", "bold"))).alias("_w"))
    start = F.array().cast("array<boolean>")

    def step(acc: Column, x: Column) -> Column:
        i = F.size(acc)
        short = F.length(F.regexp_replace(x["text"], "[^A-Za-zÀ-ú0-9]", "")) <= 3
        between = F.coalesce(F.get(acc, i - 1), F.lit(False)) & F.coalesce(F.get("_w", i + 1)["bold"], F.lit(False))
        return F.concat(acc, F.array(x["bold"] | (short & between)))

    rows = rows.withColumn("_b", F.aggregate("_w", start, step))
    return rows.select(*keys, F.inline(F.zip_with("_w", "_b", lambda w, b: F.struct(w[order].alias(order), w["text"].alias("text"), b.alias("bold")))))


def merge_tiles(images: DataFrame, gap: float = 1.5, off: float = 2.0) -> DataFrame:
    """Pictures cut in tiles, as one box each: tiles touch when one continues the other's
    column or row. Merged boxes can touch again, so each page repeats until none does."""
    import pandas as pd

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = rows[["x0", "y0", "x1", "y1"]].to_numpy().tolist()

        def touch(a: list[float], b: list[float]) -> bool:
            apart_x, apart_y = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
            same_x, same_y = abs(a[0] - b[0]) < off and abs(a[2] - b[2]) < off, abs(a[1] - b[1]) < off and abs(a[3] - b[3]) < off
            return (same_x and apart_y <= gap) or (same_y and apart_x <= gap)

        merged: list[list[float]] = []
        for box in boxes:
            while (k := next((k for k, m in enumerate(merged) if touch(m, box)), None)) is not None:
                m = merged.pop(k)
                box = [min(m[0], box[0]), min(m[1], box[1]), max(m[2], box[2]), max(m[3], box[3])]
            merged.append(box)
        out = pd.DataFrame(sorted(merged, key=lambda m: (m[1], m[0])), columns=["x0", "y0", "x1", "y1"])
        return out.assign(doc=rows["doc"].iloc[0], page=rows["page"].iloc[0], ord=range(len(out)))[["doc", "page", "ord", "x0", "y0", "x1", "y1"]]

    return images.select("doc", "page", "ord", "x0", "y0", "x1", "y1").groupBy("doc", "page").applyInPandas(page, "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double")


def stage_pages(lines: DataFrame) -> DataFrame:
    """(doc, stage, rank, start): the page on which each stage begins, from the first page
    of contents that names one: the number on the stage's own baseline."""
    contents = lines.where(F.col("text").contains("Sumário")).select(*ON).distinct()
    there = lines.join(contents, ON).select(*ON, "base", "ord", t.strip(F.col("text")).alias("text"))
    names = there.where(F.col("text").isin(*STAGES)).groupBy(*ON, F.col("text").alias("stage")).agg(F.min_by("base", "ord").alias("base"))
    numbers = there.where(F.col("text").rlike(r"^\d{1,3}$")).select(*ON, F.col("base").alias("_b"), F.col("ord").alias("_o"), F.col("text").cast("int").alias("start"))
    met = names.join(numbers, ON).where(F.abs(F.col("base") - F.col("_b")) < 6).groupBy(*ON, "stage").agg(F.min_by("start", "_o").alias("start"))
    first = met.groupBy("doc").agg(F.min("page").alias("page"))
    rank = F.create_map(*[F.lit(v) for k, s in enumerate(STAGES) for v in (s, k)])
    return met.join(first, ON, "left_semi").select("doc", "stage", F.try_element_at(rank, "stage").alias("rank"), "start")


def bar_text_votes(bars_: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, number, y0, one_column): what a bar's own text says. Its last spans, up
    to a gap or the number, name a bank: at the page's right end it spans the page, before
    the middle a column; anything else is no vote."""
    bar = bars_.select(*ON, "number", "y0", ((F.col("y0") + F.col("y1")) / 2).alias("_c"))
    s = spans.where(t.strip(F.col("text")) != "").select(*ON, F.struct("x0", "x1", t.strip(F.col("text")).alias("text")).alias("s"), ((F.col("y0") + F.col("y1")) / 2).alias("_sc"))
    own = bar.join(s, ON).where(F.abs(F.col("_sc") - F.col("_c")) < 3).groupBy(*ON, "number", "y0").agg(F.array_sort(F.collect_list("s")).alias("s")).join(pages, ON)
    return own.select(*ON, "number", "y0", bank_vote(F.col("s"), F.col("width") / 2).alias("one_column")).where("one_column is not null")


def bank_vote(spans: Column, middle: Column) -> Column:
    """What the spans (x0, x1, text) of a bar, from left to right, say about columns; null if nothing."""

    def cut(s: Column) -> Column:
        parts = lambda k: (F.get(s, k)["x0"] - F.get(s, k - 1)["x1"] >= 12) | F.get(s, k - 1)["text"].rlike(BAR)
        return F.when(F.size(s) >= 2, F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), parts)))

    def vote(v: Column) -> Column:
        s, k, n = v["s"], v["k"], F.size(v["s"])
        text = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), " ")
        bank, before = F.slice(s, k + 1, n), F.slice(s, F.lit(1), k)
        whole = (F.get(s, k)["x0"] > middle + 30) & (F.array_max(F.transform(before, lambda x: x["x1"])) < middle - 30)
        column = F.get(s, n - 1)["x1"] < middle + 4
        return F.when(k.isNotNull() & text(bank).rlike(BANK) & text(before).rlike(BAR), F.when(whole, True).when(column, False))

    return t.once(spans, lambda s: t.bound(vote, s=s, k=cut(s)))


def side_by_side(bars_: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page): pages with two bars at one height, one left and one right of the middle."""
    placed = bars_.join(pages, ON).select(*ON, "y1", (F.col("x0") >= F.col("width") / 2).alias("right"))
    left, right = placed.where("not right").select(*ON, F.col("y1").alias("_l")), placed.where("right").select(*ON, F.col("y1").alias("_r"))
    return left.join(right, ON).where(F.abs(F.col("_l") - F.col("_r")) < 4).select(*ON).distinct()


def better_model(model: DataFrame, outside_one: DataFrame, outside_two: DataFrame) -> DataFrame:
    """model (doc, page, one_column) turned over where the page has content outside all
    segments and the other model leaves less of it outside."""
    count = lambda rows, name: rows.groupBy(*ON).agg(F.count(F.lit(1)).alias(name))
    both = model.join(count(outside_one, "_one"), ON, "left").join(count(outside_two, "_two"), ON, "left").na.fill(0, ["_one", "_two"])
    own, other = [F.when(F.col("one_column"), a).otherwise(b) for a, b in ((F.col("_one"), F.col("_two")), (F.col("_two"), F.col("_one")))]
    return both.select(*ON, (F.col("one_column") != ((own > 0) & (other < own))).alias("one_column"))


def trim_figures(figures_: DataFrame, lines: DataFrame) -> DataFrame:
    """figures_ (doc, page, ord, x0, y0, x1, y1) without the text they reach into. Lines
    that cross the upper or lower edge cut it, one after the other; of running text inside
    the longest stretch without any stays. Labels inside stay."""
    item = F.struct("ord", "x0", "y0", "x1", "y1", "text")
    near = lines.select(*ON, item.alias("l")).groupBy(*ON).agg(near_lines(F.collect_list("l")).alias("_lines"))  # the lines of a page
    rows = figures_.join(near, ON, "left").withColumn("_lines", F.coalesce("_lines", F.array().cast(near.schema["_lines"].dataType)))
    rows = rows.withColumn("_best", t.once(F.col("_lines"), lambda n: trimmed(F.struct("x0", "y0", "x1", "y1"), n)))
    return rows.select(*[F.col("_best.y0").alias("y0") if c == "y0" else F.col("_best.y1").alias("y1") if c == "y1" else F.col(c) for c in figures_.columns])


def near_lines(lines: Column) -> Column:
    """The lines (ord, x0 to y1, text) of a page, an array, in order with what trimmed() asks of their texts."""

    def of(l: Column) -> Column:
        told = lambda w: [F.size(F.array_remove(w, "")).alias("words"), F.forall(w, lambda x: F.length(x) <= 2).alias("short")]
        return t.once(F.split(t.strip(l["text"]), r"(?U)\s+"), lambda w: F.struct(*[l[c].alias(c) for c in ("ord", "x0", "y0", "x1", "y1")], *told(w), l["text"].rlike(BAR).alias("bar")))

    return F.sort_array(F.transform(lines, of))


def trimmed(f: Column, lines: Column) -> Column:
    """(size, up, y0, y1): how far a figure (x0 to y1) reaches when near_lines() have cut it; see trim_figures()."""

    def cut(r: Column, l: Column) -> Column:
        beside = (l["x1"] < f["x0"]) | (l["x0"] > f["x1"]) | l["short"]
        low, high = (l["y0"] < r["y1"]) & (r["y1"] < l["y1"]), (l["y0"] < r["y0"]) & (r["y0"] < l["y1"])
        return F.struct(F.when(~beside & ~low & high, l["y1"] + 1).otherwise(r["y0"]).alias("y0"), F.when(~beside & low, l["y0"] - 1).otherwise(r["y1"]).alias("y1"))

    wide = f["x1"] - f["x0"]

    def best(r: Column) -> Column:
        running = lambda l: (
            (l["x0"] < f["x1"]) & (l["x1"] > f["x0"]) & (l["y0"] >= r["y0"] - 1) & (l["y1"] <= r["y1"] + 1)
            & (((l["words"] >= 5) & (l["x1"] - l["x0"] >= 0.5 * wide)) | l["bar"]) & (wide >= 0.4 * (l["x1"] - l["x0"]))
        )
        within = F.sort_array(F.transform(F.filter(lines, running), lambda l: F.struct(l["y0"].alias("y0"), l["y1"].alias("y1"))))
        return t.once(within, lambda i: longest(r, i))

    def longest(r: Column, within: Column) -> Column:
        starts, ends = F.concat(F.array(r["y0"]), F.transform(within, lambda l: l["y1"] + 1)), F.concat(F.transform(within, lambda l: l["y0"] - 1), F.array(r["y1"]))
        free = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct((b - a).alias("size"), (-a).alias("up"), a.alias("y0"), b.alias("y1"))), lambda x: x["size"] > 0)
        return F.coalesce(F.array_max(free), F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("up"), r["y0"].alias("y0"), r["y1"].alias("y1")))

    return t.once(F.aggregate(lines, F.struct(f["y0"].alias("y0"), f["y1"].alias("y1")), cut), best)


def equation_systems(braces: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc, page, ord, latex): tall thin glyphs with equations right of them, on two lines
    or more. pieces: the pieces of text lines (doc, page, line, ord, text, x0, y0, y1)."""
    tall = (F.col("y1") - F.col("y0") >= 16) & (F.col("x1") - F.col("x0") <= 18) & (F.col("x1") - F.col("x0") <= 0.5 * (F.col("y1") - F.col("y0")))
    b = braces.where(tall).select(*ON, "ord", F.col("y0").alias("_t"), F.col("y1").alias("_b"), F.col("x1").alias("_x"))
    p = pieces.select(*ON, "line", F.col("ord").alias("_o"), "text", "x0", ((F.col("y0") + F.col("y1")) / 2).alias("_c"))
    right = b.join(p, ON).where((F.col("_c") > F.col("_t") - 2) & (F.col("_c") < F.col("_b") + 2) & (F.col("x0") >= F.col("_x") - 3))
    rows = right.groupBy(*ON, "ord", "line").agg(F.min(F.col("x0") - F.col("_x")).alias("_near"), F.min("_c").alias("_c"), F.array_sort(F.collect_list(F.struct("_o", "text"))).alias("_p"))
    rows = rows.where("_near < 25").withColumn("eq", t.latex_of_line(t.strip(F.array_join(F.transform("_p", lambda x: x["text"]), ""))))
    per = rows.groupBy(*ON, "ord").agg(F.array_sort(F.collect_list(F.struct("_c", "line", "eq"))).alias("_e"))
    equations = F.transform("_e", lambda x: x["eq"])
    return per.where((F.size("_e") >= 2) & ~F.array_contains(equations, "")).select(*ON, "ord", t.cases_of(equations).alias("latex"))
