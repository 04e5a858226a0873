"""The layout of pages from their primitives: one column or two, by evidence and guards.

A page is one row with what lies on it in arrays, so what a task gathers at once is a page, and lines, bars, segments
and what they leave outside are made for both candidates without joins: a page is dealt out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import segment
from .ordered import anchored, carry_down
from .segment import BAR, ON, STAGES, TOP

# How far from the middle the gutter's edges lie, the words that running text has on either
# side, how many such lines (or lines across the middle) are evidence, and how near to its first piece's baseline a line's pieces lie.
GUTTER, WORDS, LINES, SAME_LINE = (4.0, 40.0), 3, 3, 2.5
#: What lies on a page, in the order of fields that sorts spans into lines.
SPANS = "array<struct<base: double, x0: double, x1: double, y0: double, y1: double, text: string>>"
IMAGES = "array<struct<ord: long, x0: double, y0: double, x1: double, y1: double>>"
DRAWINGS = "array<struct<x0: double, y0: double, x1: double, y1: double, fill: array<double>>>"
SEGMENTS = "array<struct<col: int, kind: string, number: int, x0: double, y0: double, x1: double, y1: double>>"


def page_rows(pages: DataFrame, spans: DataFrame, images: DataFrame, drawings: DataFrame, bottoms: DataFrame) -> DataFrame:
    """(doc, page, width, height, bottom, spans, images, drawings): what lies on each page, as arrays (null: nothing)."""
    held = lambda rows, name, kind, *of: rows.groupBy(*ON).agg(F.collect_list(F.struct(*of)).cast(kind).alias(name))
    out = pages.select(*ON, "width", "height").join(bottoms.select(*ON, "bottom"), ON, "left")
    out = out.join(held(spans, "spans", SPANS, "base", "x0", "x1", "y0", "y1", "text"), ON, "left")
    out = out.join(held(images, "images", IMAGES, "ord", "x0", "y0", "x1", "y1"), ON, "left")
    return out.join(held(drawings, "drawings", DRAWINGS, "x0", "y0", "x1", "y1", "fill"), ON, "left")


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _count(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test))


def told(text: Column) -> list[Column]:
    """named: a text is a bar's; content: it is more than a stage's name."""
    return [text.rlike(BAR).alias("named"), ((F.length(text) >= 2) & ~text.isin(*STAGES)).alias("content")]


def _lines(spans: Column, col: int) -> Column:
    """The lines (col, pieces, text, x0, y0, x1, y1, named, content) of a column's spans. Equal places go by the rest of a span."""
    groups = anchored(F.sort_array(spans), "base", SAME_LINE)

    def line(g: Column) -> Column:
        pieces = F.sort_array(F.transform(g, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), s["text"].alias("text"))))
        of = lambda c: F.transform(g, lambda s: s[c])
        box = {"x0": F.array_min(of("x0")), "y0": F.array_min(of("y0")), "x1": F.array_max(of("x1")), "y1": F.array_max(of("y1"))}
        said = lambda p: F.struct(p.alias("pieces"), F.array_join(F.transform(p, lambda x: x["text"]), " ").alias("text"))
        full = lambda v: F.struct(F.lit(col).alias("col"), v["pieces"].alias("pieces"), v["text"].alias("text"), *[c.alias(k) for k, c in box.items()], *told(v["text"]))
        return t.once(t.once(pieces, said), full)

    return F.transform(groups, line)


def bars(lines: Column) -> Column:
    """segment.bars() of a page's lines."""
    number = lambda x: F.replace(F.regexp_extract(x["text"], BAR, 1), F.lit(" "), F.lit("")).cast("int")
    return F.transform(F.filter(lines, lambda x: x["named"] & (x["y0"] > TOP)), lambda x: F.struct(number(x).alias("number"), *[x[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))


def _column_segments(v: Column, lines: Column, bars: Column, col: int, c0: Column, c1: Column) -> Column:
    part = lambda kind, number, y0, y1: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), number.alias("number"), (c0 + 2).alias("x0"), y0.alias("y0"), (c1 - 2).alias("x1"), y1.alias("y1"))
    own = F.sort_array(F.transform(bars, lambda b: F.struct(b["y0"].alias("y0"), b["number"].alias("number"))))
    ended = lambda o: F.struct(o.alias("own"), (F.coalesce(F.get(o, F.lit(0))["y0"], v["bottom"]) - 2).alias("end"))

    def of(u: Column) -> Column:
        within = lambda b: ((b["x0"] + b["x1"]) / 2).between(c0 + 2, c1 - 2) & ((b["y0"] + b["y1"]) / 2).between(F.lit(TOP), u["end"])
        held = F.exists(lines, lambda x: x["content"] & within(x)) | F.exists(v["shown"], within)
        top = F.when((u["end"] - TOP > 6) & held, F.array(part("continued", F.lit(None).cast("int"), F.lit(TOP), u["end"]))).otherwise(_none(SEGMENTS))
        return F.concat(F.transform(u["own"], lambda b, i: part("new", b["number"], b["y0"] - 2, F.coalesce(F.get(u["own"], i + 1)["y0"], v["bottom"]) - 2)), top)

    return t.once(t.once(own, ended), of)


def page_segments(v: Column, lines: Column, bars_: Column, one: bool) -> Column:
    """segment.segments() of one page (width, middle, bottom, shown: its figures) in one column or two; none without a bottom."""
    if one:
        parts = [_column_segments(v, lines, bars_, 0, F.lit(0.0), v["width"])]
    else:
        left = lambda b: F.coalesce(b["x0"] < v["middle"], F.lit(False))
        parts = [_column_segments(v, lines, F.filter(bars_, left), 0, F.lit(0.0), v["middle"]), _column_segments(v, lines, F.filter(bars_, lambda b: ~left(b)), 1, v["middle"], v["width"])]
    return F.when(v["bottom"].isNotNull(), F.concat(*parts).cast(SEGMENTS)).otherwise(_none(SEGMENTS))


def _outside(v: Column, lines: Column, segments: Column) -> Column:
    """How many lines and figures of a page lie outside all segments; see segment.stray_content()."""

    def stray(b: Column) -> Column:
        y = (b["y0"] + b["y1"]) / 2
        held = lambda s: (b["x0"] >= s["x0"] - 6) & (b["x1"] <= s["x1"] + F.greatest(F.lit(8.0), 0.08 * (s["x1"] - s["x0"]))) & y.between(s["y0"], s["y1"] + 2)
        return ~F.coalesce(F.exists(segments, held), F.lit(False))

    texts = _count(lines, lambda x: x["content"] & ~x["named"] & (x["y0"] >= TOP) & (x["y0"] < v["bottom"] - 2) & stray(x))
    return texts + _count(v["shown"], lambda x: (x["y0"] < v["bottom"]) & stray(x))


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def _gutter(lines: Column, width: Column) -> Column:
    """How many lines have a gap in the gutter between columns and running text on both sides of it. One fold over
    a line's pieces, which carries the words so far and where they end."""
    near, far = GUTTER
    middle = width / 2
    start = F.struct(F.lit(0).alias("words"), F.lit(None).cast("double").alias("end"), F.lit(False).alias("hit"))

    def hit(p: Column) -> Column:
        words = F.transform(p, lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), _words(x["text"]).alias("n")))
        total = lambda w: F.struct(w.alias("p"), F.aggregate(w, F.lit(0), lambda a, x: a + x["n"]).alias("total"))

        def step(u: Column):
            def of(a: Column, x: Column) -> Column:
                ends = (a["end"] < middle - near) & (a["end"] > middle - far)
                begins = (x["x0"] > middle + near) & (x["x0"] < middle + far)
                found = a["hit"] | F.coalesce(ends & begins & (a["words"] >= WORDS) & (u["total"] - a["words"] >= WORDS), F.lit(False))
                return F.struct((a["words"] + x["n"]).alias("words"), x["x1"].alias("end"), found.alias("hit"))

            return of

        return t.once(t.once(words, total), lambda u: F.aggregate(u["p"], start, step(u))["hit"])

    return _count(lines, lambda x: (F.size(x["pieces"]) > 1) & (x["y0"] > TOP) & ~x["named"] & hit(x["pieces"]))


def middle(images: Column, width: Column, height: Column) -> Column:
    """Where a page's columns part: the middle of the first thin tall rule, else of the page; see segment.column_split()."""
    thin = F.filter(images, lambda i: (i["x1"] - i["x0"] < 3) & (i["y1"] - i["y0"] > height * 0.6) & i["ord"].isNotNull())
    rule = F.array_min(F.transform(thin, lambda i: F.struct(i["ord"].alias("ord"), ((i["x0"] + i["x1"]) / 2).alias("at"))))["at"]
    return F.coalesce(rule, width / 2)


def _votes(v: Column, bars: Column) -> Column:
    """(said, vote) of each bar: how far its text reaches, or else the box behind it."""
    half = v["width"] / 2

    def of(b: Column) -> Column:
        at = (b["y0"] + b["y1"]) / 2
        own = F.filter(v["spans"], lambda s: F.abs((s["y0"] + s["y1"]) / 2 - at) < 3)
        said = segment.bank_vote(F.sort_array(F.transform(own, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), s["text"].alias("text")))), half)
        end = F.array_max(F.transform(F.filter(v["drawings"], lambda d: segment.box_behind(b, d)), lambda d: d["x1"]))
        box = lambda e: F.when(e.isNotNull(), (b["x0"] < half - 30) & (e > half + 30))
        return t.once(said, lambda s: F.struct(s.alias("said"), F.coalesce(s, t.once(end, box)).alias("vote")))

    return F.transform(bars, of)


def _evidence(rows: DataFrame) -> DataFrame:
    """rows (page_rows()) with e, what speaks for one column or two. right: a bar begins right of the middle (null without
    bars); votes and ayes: bars that tell how far they reach, by their text or else by the box behind
    them; whole: bars whose text spans the page; crossing and gutter: lines across the middle, and with a gap there;
    one and two: the segments of either candidate and how much lies outside them."""
    double = lambda c: F.col(c).cast("double")
    images, spans = F.coalesce("images", _none(IMAGES)), F.coalesce("spans", _none(SPANS))
    plain = F.transform(spans, lambda s: s.withField("text", t.strip(s["text"])))
    given = {
        "width": double("width"), "bottom": double("bottom"), "middle": middle(images, double("width"), F.col("height")), "drawings": F.coalesce("drawings", _none(DRAWINGS)),
        "spans": F.filter(plain, lambda s: s["text"] != ""), "shown": F.filter(images, segment.is_figure),
    }

    def candidate(v: Column, lines: Column, bars_: Column, one: bool) -> Column:
        return t.once(page_segments(v, lines, bars_, one), lambda s: F.struct(s.alias("segments"), _outside(v, lines, s).alias("outside")))

    def of(v: Column, u: Column, b: Column) -> Column:
        right = F.array_max(F.transform(F.concat(b["one"], b["two"]), lambda x: x["x0"] >= v["width"] / 2))
        crossing = _count(v["spans"], lambda s: (F.length(s["text"]) >= 8) & (s["x0"] < v["width"] / 2 - 15) & (s["x1"] > v["width"] / 2 + 15))
        votes = lambda w: [_count(w, lambda x: x["vote"].isNotNull()).alias("votes"), _count(w, lambda x: x["vote"]).alias("ayes"), _count(w, lambda x: x["said"]).alias("whole"), F.size(w).alias("n_bars")]
        out = [right.alias("right"), crossing.alias("crossing"), _gutter(u["one"], v["width"]).alias("gutter")]
        out += [candidate(v, u["one"], b["one"], True).alias("one"), candidate(v, u["two"], b["two"], False).alias("two")]
        return t.once(_votes(v, b["one"]), lambda w: F.struct(*votes(w), *out))

    def lined(v: Column) -> Column:
        left = lambda s: F.coalesce((s["x0"] + s["x1"]) / 2 < v["middle"], F.lit(False))
        two = F.concat(_lines(F.filter(v["spans"], left), 0), _lines(F.filter(v["spans"], lambda s: ~left(s)), 1))
        barred = lambda u: t.bound(lambda b: of(v, u, b), one=bars(u["one"]), two=bars(u["two"]))
        return t.bound(barred, one=_lines(v["spans"], 0), two=two)

    return rows.select(*ON, t.bound(lined, **given).alias("e")).select(*ON, "e.*")


def row_layouts(rows: DataFrame) -> DataFrame:
    """(doc, page, one_column, rule, segments) of page_rows(); see page_layout()."""
    e = _evidence(rows)
    m = F.when(F.col("right"), F.struct(F.lit(False).alias("one"), F.lit("right bar").alias("rule")))
    m = m.when(F.col("votes") > 0, F.struct((F.col("ayes") * 2 > F.col("votes")).alias("one"), F.lit("votes").alias("rule")))
    m = m.otherwise(F.struct((F.col("crossing") >= LINES).alias("one"), F.lit("crossing").alias("rule")))
    e = e.withColumn("m", F.when(F.col("right").isNotNull(), m))
    sure = (F.col("votes") > 0) & (F.col("ayes") == F.col("votes"))
    gutter = (F.col("gutter") >= LINES) & (F.col("right").isNull() | (F.col("m.one") & ~sure))
    e = e.withColumn("m", F.when(gutter, F.struct(F.lit(False).alias("one"), F.lit("gutter").alias("rule"))).otherwise(F.col("m")))
    coherent = ~F.col("m.one") & ~F.col("right") & (F.col("n_bars") > 0) & (F.col("whole") == F.col("n_bars"))
    e = e.withColumn("m", F.when(coherent, F.struct(F.lit(True).alias("one"), F.lit("whole bars").alias("rule"))).otherwise(F.col("m")))
    # Of the candidates the one that leaves least outside, the chosen one where they tie.
    own, other = [F.when(F.col("m.one"), F.col(a)).otherwise(F.col(b)) for a, b in (("one.outside", "two.outside"), ("two.outside", "one.outside"))]
    flips = F.col("right").isNotNull() & (other < own)
    e = e.withColumn("m", F.when(flips, F.struct((~F.col("m.one")).alias("one"), F.lit("covers").alias("rule"))).otherwise(F.col("m")))
    # Where the page itself decides, only its own candidate's segments go on to the document.
    kept = lambda mine, c: F.when(F.coalesce(F.col("m.one") == mine, F.lit(True)), F.col(c)["segments"]).alias(c)
    e = e.select(*ON, "m", kept(True, "one"), kept(False, "two"))
    e = carry_down(e, ["doc"], ["page"], F.col("m.one"), "_one")
    one = F.coalesce("_one", F.lit(False))
    return e.select(*ON, one.alias("one_column"), F.coalesce("m.rule", F.lit("page before")).alias("rule"), F.when(one, F.col("one")).otherwise(F.col("two")).alias("segments"))


def page_layout(pages: DataFrame, spans: DataFrame, images: DataFrame, drawings: DataFrame, bottoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, page, one_column, rule) and the segments of that layout.

    In this order: a bar in the right half means two columns; bars vote by how far they reach; text across
    the middle means one; a page without bars is like the one before. Then the guards: three lines
    with a gap in the gutter mean two columns, unless all votes are for one; bars that all span the page
    mean one; and a page with bars takes the other layout if that leaves less of its content outside
    all segments. rule names what decided. Pages without anything on them are like the one before.
    """
    return layout_of(page_rows(pages, spans, images, drawings, bottoms))


def layout_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_layout() of pages that are rows already; see page_rows()."""
    found = row_layouts(rows)
    return found.select(*ON, "one_column", "rule"), found.select(*ON, F.inline("segments"))
