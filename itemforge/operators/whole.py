"""Whole segments: their text with formulas and figures at the places where they stand.

A page is one row with its lines, formulas and figures in arrays, and what a segment of it holds follows from that row
alone: no step joins, so a page is dealt out once and what one task gathers is bounded by a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import answers, layout, segment
from .ordered import banded
from .pieces import marked_pieces, page_lines, page_pieces
from .segment import ON

PART = [*ON, "part"]
BOX = ["x0", "y0", "x1", "y1"]
# A brace's least height, its greatest width and share of the height; how far its lines' centres may lie
# outside, how far an equation may begin before its right edge and, at most, behind it; the room around what a part holds.
TALL, THIN, SLIM = 16.0, 18.0, 0.5
BEYOND, LAP, NEAR = 2.0, 3.0, 25.0
ABOVE, BELOW = 6.0, 8.0
MARK = "⟦FÓRMULA #"
#: What a page holds; figures of a part in reading order, before that by band.
INKS = "array<struct<x0: double, y0: double, x1: double, y1: double, image: boolean>>"
TRIMMED = "array<struct<ord: long, x0: double, y0: double, x1: double, y1: double, top: double, end: double>>"
BANDED = "struct<y0: double, ord: long, x0: double, x1: double, y1: double>"
FIGURES = "array<struct<band: int, x0: double, ord: long, y0: double, x1: double, y1: double, letter: string, centred: boolean, y: double>>"


def _middle(b: Column, a: str, z: str) -> Column:
    return (b[a] + b[z]) / 2


def _within(p: Column, b: Column, x: bool = True) -> Column:
    """Whether the centre of b lies in p (its height, and its width if x)."""
    at, across = _middle(b, "y0", "y1"), _middle(b, "x0", "x1")
    high = (at > p["y0"]) & (at < p["y1"])
    return high & (across > p["x0"]) & (across < p["x1"]) if x else high


def _own_lines(p: Column, lines: Column) -> Column:
    """The lines of a part from the top; head: the first is the bar of a new segment; i counts from 0."""
    held = F.filter(lines, lambda l: (l["col"] == p["col"]) & _within(p, l, x=False))
    ordered = F.sort_array(F.transform(held, lambda l: F.struct(l["base"].alias("base"), l["line_no"].alias("line_no"), l.alias("l"))))
    fields = ("text", "marked", "pieces", *BOX)
    return F.transform(ordered, lambda o, i: F.struct(i.alias("i"), ((p["kind"] == "new") & (i == 0)).alias("head"), *[o["l"][c].alias(c) for c in fields]))


def _own_formulas(p: Column, inks: Column) -> Column:
    """The inks (x0 to y1, image) of a part, numbered k from 0 downwards, then to the right."""
    own = F.filter(inks, lambda f: _within(p, f))
    ordered = F.sort_array(F.transform(own, lambda f: F.struct(*[f[c].alias(c) for c in ("y0", "x0", "y1", "x1", "image")])))
    return F.transform(ordered, lambda f, k: F.struct(k.alias("k"), *[f[c].alias(c) for c in BOX], f["image"].alias("image")))


def _systems(formulas: Column, lines: Column) -> Column:
    """(k, latex, rows, x0, y0, x1, y1): the braces among formulas with equations of two lines or more to their right. A line
    belongs to the first brace that takes it, so the braces of a part are gone through in order; one with an
    unreadable equation takes none."""
    row = "struct<i: int, eq: string, y0: double, y1: double, x1: double>"
    brace = f"struct<k: int, x0: double, y0: double, y1: double, rows: array<{row}>>"

    def tall(f: Column) -> Column:
        high, wide = f["y1"] - f["y0"], f["x1"] - f["x0"]
        return ~f["image"] & (high >= TALL) & (wide <= THIN) & (wide <= SLIM * high)

    def rows(f: Column) -> Column:
        y = lambda l: _middle(l, "y0", "y1")
        beside = F.filter(lines, lambda l: ~l["head"] & (y(l) > f["y0"] - BEYOND) & (y(l) < f["y1"] + BEYOND))
        right = F.transform(beside, lambda l: F.struct(l["i"].alias("i"), l["y0"].alias("y0"), l["y1"].alias("y1"), l["x1"].alias("x1"), F.filter(l["pieces"], lambda p: p["x0"] >= f["x1"] - LAP).alias("p")))
        right = F.filter(right, lambda l: F.exists(l["p"], lambda p: p["x0"] - f["x1"] < NEAR))
        equation = lambda l: t.once(t.strip(F.array_join(F.transform(l["p"], lambda p: p["text"]), "")), t.latex_of_line)
        return F.transform(right, lambda l: F.struct(l["i"].alias("i"), F.coalesce(equation(l), F.lit("")).alias("eq"), l["y0"].alias("y0"), l["y1"].alias("y1"), l["x1"].alias("x1")))

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(f"array<{brace}>").alias("found"))

    def step(s: Column, f: Column) -> Column:
        def of(free: Column) -> Column:
            good = (F.size(free) >= 2) & ~F.exists(free, lambda r: r["eq"] == "")
            with_it = F.struct(F.concat(s["taken"], F.transform(free, lambda r: r["i"])).alias("taken"), F.concat(s["found"], F.array(F.struct(f["k"].alias("k"), f["x0"].alias("x0"), f["y0"].alias("y0"), f["y1"].alias("y1"), free.alias("rows")))).alias("found"))
            return F.when(good, with_it).otherwise(s)

        return t.once(F.filter(rows(f), lambda r: ~F.array_contains(s["taken"], r["i"])), of)

    def out(b: Column) -> Column:
        of = lambda c: F.transform(b["rows"], lambda r: r[c])
        box = [b["x0"].alias("x0"), F.least(b["y0"], F.array_min(of("y0"))).alias("y0"), F.array_max(of("x1")).alias("x1"), F.greatest(b["y1"], F.array_max(of("y1"))).alias("y1")]
        return F.struct(b["k"].alias("k"), t.cases_of(of("eq")).alias("latex"), of("i").alias("rows"), *box)

    return F.transform(F.aggregate(F.filter(formulas, tall), start, step, lambda s: s["found"]), out)


def _centred(p: Column, u: Column, x0: Column, x1: Column, letters: Column) -> Column:
    left, right, mid = u["left"], u["right"], (x0 + x1) / 2
    width = F.greatest(F.lit(1.0), right - left)
    near = lambda c: F.abs(mid - c) < 0.04 * width
    return (x1 - x0 < 0.8 * width) & (x0 - left > 0.06 * width) & (near((left + right) / 2) | near(_middle(p, "x0", "x1"))) & (letters >= 3)


def _between(pieces: Column, marks: Column) -> Column:
    """Pieces of a line with marks (x0, k, mark) between them: a mark stands before the first piece whose middle lies
    right of the mark's left edge."""
    group = lambda g: F.filter(pieces, lambda p: F.size(F.filter(marks, lambda m: m["x0"] < (p["x0"] + p["x1"]) / 2)) == g)
    texts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), lambda g: F.array(t.strip(marked_pieces(group(g))), F.coalesce(F.get(marks, g)["mark"], F.lit("")))))
    return F.array_join(F.filter(texts, lambda x: x != ""), " ")


def _marked_formulas(formulas: Column, systems: Column, lines: Column) -> Column:
    """(k, x0 to y1, image, latex, mark, line): formulas with their boxes as systems, the mark of each and the line that hosts it,
    null for systems and what has a line of its own."""

    def host(f: Column) -> Column:
        hosts = F.filter(lines, lambda l: ~l["head"] & answers.hosts(f, l))
        return F.array_min(F.transform(hosts, lambda l: F.struct((-answers.shared_height(f, l)).alias("s"), l["i"].alias("i"))))["i"]

    def of(f: Column) -> Column:
        name = F.concat(F.lit(MARK), f["k"].cast("string"))
        system = lambda s: F.struct(
            f["k"].alias("k"), *[F.coalesce(s[c], f[c]).alias(c) for c in BOX], f["image"].alias("image"), s["latex"].alias("latex"),
            F.concat(name, F.coalesce(F.concat(F.lit(" = $"), s["latex"], F.lit("$")), F.lit("")), F.lit("⟧")).alias("mark"), F.when(s["k"].isNull(), host(f)).alias("line"),
        )
        return t.once(F.get(F.filter(systems, lambda s: s["k"] == f["k"]), F.lit(0)), system)

    return F.transform(formulas, of)


def _entries(p: Column, u: Column) -> Column:
    """(y, alone, n, text): the lines of a part as they are shown, and the formulas that have a line of their own."""
    prefix = lambda b, letters: F.when(_centred(p, u, b["x0"], b["x1"], letters), t.CENTRED_MARK).otherwise("")
    entry = lambda b, alone, n, text: F.struct(_middle(b, "y0", "y1").alias("y"), F.lit(alone).alias("alone"), n.alias("n"), text.alias("text"))
    hosted = lambda i: F.sort_array(F.transform(F.filter(u["formulas"], lambda f: f["line"] == i), lambda f: F.struct(f["x0"].alias("x0"), f["k"].alias("k"), f["mark"].alias("mark"))))

    def line(l: Column) -> Column:
        def of(v: Column) -> Column:
            marks, system = v["marks"], v["system"]
            body = F.when(F.size(marks) == 0, l["marked"]).otherwise(_between(l["pieces"], marks))
            before = t.strip(marked_pieces(F.filter(l["pieces"], lambda x: x["x1"] <= system["x0"] + LAP)))
            name = F.get(F.filter(u["formulas"], lambda f: f["k"] == system["k"]), F.lit(0))["mark"]
            first = F.array_join(F.filter(F.concat(F.array(before, name), F.transform(marks, lambda m: m["mark"])), lambda x: x != ""), " ")
            shown = F.when(l["head"], l["text"]).when(F.get(system["rows"], F.lit(0)) == l["i"], first).when(system.isNotNull(), "")
            return entry(l, False, l["i"], shown.otherwise(F.concat(prefix(l, F.length(t.strip(l["text"]))), body)))

        return t.bound(of, marks=hosted(l["i"]), system=F.get(F.filter(u["systems"], lambda s: F.array_contains(s["rows"], l["i"])), F.lit(0)))

    alone = F.filter(u["formulas"], lambda f: f["latex"].isNull() & f["line"].isNull())
    orphans = F.transform(alone, lambda f: entry(f, True, f["k"], F.concat(prefix(f, F.lit(3)), f["mark"])))
    return F.sort_array(F.concat(F.transform(u["lines"], line), orphans))


def _own_figures(p: Column, u: Column, figures: Column) -> Column:
    """(band, x0, ord, y0, x1, y1, letter, centred, y): the figures (ord, x0 to y1, top and end as trimmed) of a part in reading order."""
    held = F.filter(figures, lambda f: _within(p, f))
    trimmed = F.transform(held, lambda f: F.struct(f["top"].alias("y0"), f["ord"].alias("ord"), f["x0"].alias("x0"), f["x1"].alias("x1"), f["end"].alias("y1")))

    def placed(b: Column) -> Column:
        def figure(f: Column) -> Column:
            side = lambda c: F.transform(F.filter(b, lambda o: o["band"] == f["band"]), lambda o: o[c])
            wide = segment.is_centred(F.array_min(side("x0")), F.array_max(side("x1")), u["left"], u["right"], _middle(p, "x0", "x1"))
            beside = F.filter(u["lines"], lambda l: ~l["head"])
            letters = F.flatten(F.transform(beside, lambda l: F.filter(F.transform(l["pieces"], lambda x: answers.letter_beside(f, x)), lambda x: x.isNotNull())))
            of = lambda x: F.struct(
                *[f[c].alias(c) for c in ("band", "x0", "ord", "y0", "x1", "y1")], x.alias("letter"), (wide & x.isNull()).alias("centred"),
                F.when(x.isNull(), f["y0"]).otherwise(_middle(f, "y0", "y1")).alias("y"),
            )
            return t.once(F.array_min(letters)["letter"], of)

        return F.sort_array(F.transform(b, figure))

    return F.when(F.size(held) == 0, F.array().cast(FIGURES)).otherwise(t.once(banded(F.sort_array(trimmed), BANDED), placed).cast(FIGURES))


def _contents(p: Column, v: Column) -> Column:
    """(lines, formulas, figures, top, end) of a part p (col, kind, x0 to y1) of the page v; see part_contents()."""

    def marked(u: Column) -> Column:
        body = lambda c: F.transform(F.filter(u["lines"], lambda l: ~l["head"]), lambda l: l[c])
        sides = {"left": F.coalesce(F.array_min(body("x0")), p["x0"]), "right": F.coalesce(F.array_max(body("x1")), p["x1"])}
        systems = lambda s: t.bound(whole, lines=u["lines"], systems=s, formulas=_marked_formulas(u["formulas"], s, u["lines"]), **sides)
        return t.once(_systems(u["formulas"], u["lines"]), systems)

    def whole(u: Column) -> Column:
        return t.bound(lambda w: out(u, w), entries=_entries(p, u), figures=_own_figures(p, u, v["figures"]))

    def out(u: Column, w: Column) -> Column:
        edge = lambda rows, c: F.transform(rows, lambda x: x[c])
        # All lines and formulas bound what is held: those in a line of their own are entries, too.
        top = F.least(*[F.array_min(edge(x, "y0")) for x in (u["lines"], u["formulas"], w["figures"])])
        end = F.greatest(*[F.array_max(edge(x, "y1")) for x in (u["lines"], u["formulas"], w["figures"])])
        above = lambda f: F.size(F.filter(w["entries"], lambda e: e["y"] < f["y"]))
        figures = F.transform(w["figures"], lambda f: F.struct(*[f[c].alias(c) for c in (*BOX, "letter", "centred")], above(f).alias("at")))
        formulas = F.transform(u["formulas"], lambda f: F.struct(*[f[c].alias(c) for c in ("k", *BOX, "latex", "image")]))
        y0 = lambda y: F.when((p["kind"] == "new") | y.isNull(), p["y0"]).otherwise(F.greatest(p["y0"], y - ABOVE))
        return F.struct(edge(w["entries"], "text").alias("lines"), formulas.alias("formulas"), figures.alias("figures"), t.once(top, y0).alias("top"), F.least(p["y1"], end + BELOW).alias("end"))

    return t.bound(marked, lines=_own_lines(p, v["lines"]), formulas=_own_formulas(p, v["inks"]))


def _trimmed(images: Column, lines: Column) -> Column:
    """The figures among images (ord, x0 to y1), with top and end, where the text they reach into has cut them."""
    near = segment.near_lines(F.transform(lines, lambda l: F.struct(l["line_no"].alias("ord"), *[l[c].alias(c) for c in (*BOX, "text")])))
    cut = lambda n: F.transform(F.filter(images, segment.is_figure), lambda f: t.once(segment.trimmed(f, n), lambda r: F.struct(f["ord"].alias("ord"), *[f[c].alias(c) for c in BOX], r["y0"].alias("top"), r["y1"].alias("end"))))
    return F.when(F.exists(images, segment.is_figure), t.once(near, cut)).otherwise(F.array().cast(TRIMMED))


def part_contents(parts: DataFrame, lines: DataFrame, inks: DataFrame, images: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc, page, part, lines, formulas, figures, y0, y1) for each of parts (doc, page, part, col, kind, x0 to y1).

    lines: its text, top to bottom, each mark of a formula in the line that hosts it, or as a line of its own; a system of
    equations is one mark in its first line, and its other lines are empty. Formulas (k, x0 to y1, latex or null, image)
    are numbered by part; figures (x0 to y1, letter, centred, at) are in reading order, at being how many of the
    lines stand above (above the middle of one with a letter). y0 and y1 bound what the part holds.

    lines: pieces.piece_lines(); inks: what isn't text nor figure (doc, page, x0 to y1, image); images: (doc, page, ord,
    x0 to y1), tiles merged. What lies in no part counts for nothing; a part that holds nothing has empty arrays and its
    own bounds. Equal places go by line, then by box. Nothing is written, so folder isn't used."""
    held = lambda rows, name, *of: rows.groupBy(*ON).agg(F.collect_list(F.struct(*of)).alias(name))
    rows = held(parts, "parts", "part", "col", "kind", *BOX)
    for name, found in (("lines", held(lines, "lines", "col", "line_no", "text", "marked", "pieces", *BOX, "base")), ("inks", held(inks, "inks", *BOX, "image")), ("images", held(images, "images", "ord", *BOX))):
        rows = rows.join(found, ON, "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    given = {"parts": F.col("parts"), "lines": F.col("lines"), "inks": F.col("inks"), "figures": _trimmed(F.col("images"), F.col("lines"))}
    of = lambda v: F.transform(v["parts"], lambda p: F.struct(p["part"].alias("part"), _contents(p, v).alias("c")))
    rows = rows.select(*ON, F.inline(t.bound(of, **given)))
    return rows.select(*PART, "c.lines", "c.formulas", "c.figures", F.col("c.top").alias("y0"), F.col("c.end").alias("y1"))


def page_parts(rows: DataFrame) -> DataFrame:
    """The segments (doc, page, col, kind, number, x0 to y1, c) of pages with what they hold (c: lines, formulas, figures, top and
    end; see part_contents()), from a row per page: (doc, page, view, width, height, bottom, one_column, items, inks,
    images), see pieces.text_pieces() and part_contents(). A page is gone through once, without joins."""
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    middle = F.when(~F.col("one_column"), F.col("width") / 2)
    given = {c: F.col(c) for c in ("width", "bottom", "one_column")} | {"images": none("images", layout.IMAGES), "inks": none("inks", INKS)}
    given |= {"middle": layout.middle(given["images"], F.col("width"), F.col("height")), "pieces": page_pieces(F.col("items"), F.col("view"), middle)}

    def lined(v: Column) -> Column:
        of = lambda c: page_lines(F.filter(v["pieces"], lambda p: p["col"] == c), c)
        return v.dropFields("pieces").withField("lines", F.concat(of(0), of(1))).withField("shown", F.filter(v["images"], segment.is_figure))

    def told(v: Column) -> Column:
        named = lambda l: t.once(t.strip(l["text"]), lambda x: F.struct(l["text"].alias("text"), *[l[c].alias(c) for c in BOX], l["text"].rlike(segment.BAR).alias("named"), layout.told(x)[1]))
        return v.withField("told", F.transform(v["lines"], named))

    def parted(v: Column) -> Column:
        of = lambda b, one: layout.page_segments(v, v["told"], b, one)
        parts = t.once(layout.bars(v["told"]), lambda b: F.when(v["one_column"], of(b, True)).otherwise(of(b, False)))
        return F.struct(parts.alias("parts"), v["lines"].alias("lines"), v["inks"].alias("inks"), _trimmed(v["images"], v["lines"]).alias("figures"))

    def held(v: Column) -> Column:
        return F.transform(v["parts"], lambda p: F.struct(*[p[c].alias(c) for c in ("col", "kind", "number", *BOX)], _contents(p, v).alias("c")))

    rows = rows.select(*ON, t.bound(lined, **given).alias("v"))  # step by step: the analyzer takes a hundred levels at most
    for step in (told, parted):
        rows = rows.select(*ON, t.once(F.col("v"), step).alias("v"))
    return rows.select(*ON, F.inline(t.once(F.col("v"), held)))


def question_contents(parts: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, question, text, formulas, figures) from the parts (doc, page, part, question, ord) of each question and their
    part_contents(): lines in order, formulas named Qnn_f1 and on in the order of their marks, figures Qnn_fig1 and on, each
    marked in a line of its own where it stands, below the first line at least. A part without lines adds none. Parts
    before the first question belong to none."""
    return question_rows(parts.where("question is not null").select(*PART, "question", "ord").join(contents.select(*PART, "lines", "formulas", "figures"), PART))


def question_rows(own: DataFrame) -> DataFrame:
    """question_contents() of parts with what they hold (doc, question, ord, lines, formulas, figures)."""
    per = own.groupBy("doc", "question").agg(F.array_sort(F.collect_list(F.struct("ord", "lines", "formulas", "figures"))).alias("_p"))
    joined = lambda c: F.flatten(F.transform("_p", lambda p: p[c]))
    before = lambda j: F.aggregate(F.slice("_p", F.lit(1), j), F.lit(0), lambda n, p: n + F.size(p["lines"]))
    moved = F.flatten(F.transform("_p", lambda p, j: F.transform(p["figures"], lambda f: f.withField("at", F.greatest(F.lit(1), f["at"] + before(j))))))
    name = F.concat(F.lit("Q"), t.two_digits(F.col("question")))
    named = lambda kind, x, k: F.struct(F.concat(name, F.lit(kind), (k + 1).cast("string")).alias("name"), x.alias("of"))
    per = per.withColumn("figures", F.transform(moved, lambda f, k: named("_fig", f, k))).withColumn("_lines", joined("lines"))
    number = r"⟦FÓRMULA #\d+"
    marks = F.transform("figures", lambda f: F.struct(f["of"]["at"].alias("at"), F.concat(F.lit("⟦FIGURA "), f["name"], F.lit("⟧")).alias("text")))
    pieces = F.split(F.array_join(answers.placed_marks(F.col("_lines"), marks), "\n"), number)
    text = t.once(pieces, lambda p: F.array_join(F.transform(p, lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.lit("⟦FÓRMULA "), name, F.lit("_f"), k.cast("string"), x))), ""))
    order = F.flatten(F.transform("_p", lambda p: F.transform(F.regexp_extract_all(F.array_join(p["lines"], "\n"), F.lit(r"⟦FÓRMULA #(\d+)"), F.lit(1)), lambda k: F.get(p["formulas"], k.cast("int")))))
    return per.select("doc", "question", text.alias("text"), F.transform(order, lambda x, k: named("_f", x, k)).alias("formulas"), "figures")
