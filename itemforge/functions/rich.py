"""Rich text: Markdown with LaTeX to the display's HTML, as column functions.

Formulas stay as they are: they are taken out, what is left is converted, and they are
put back between the pieces in their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, escape_html, format_references, once, separate_tables, strip

# Markup of centred paragraphs and tables, marks of centred blocks, of figures and of formulas.
PARAGRAPH, TABLE = '<p style="text-align: center;">', '<table style="margin-left: auto; margin-right: auto;">'
CENTRED_BLOCK = r"(?dm)^[ \t]*:::[ \t]*centro[ \t]*\n([\s\S]*?)\n[ \t]*:::[ \t]*$"
FIGURE = r"!\[([^\]]*)\]\(figura:([A-Za-z0-9_]+)\)"
ONLY_FIGURES = r"^\s*(?:!\[[^\]]*\]\(figura:[A-Za-z0-9_]+\)\s*)+$"
ANY_MATH = r"\$\$[\s\S]+?\$\$|\\\$|\$[^$\n]+?\$"
_HIDDEN, _CUT = "\u0002", "\u0003"


def inline_html(text: Column) -> Column:
    """Bold and italic as tags, other markup characters escaped, formulas untouched."""
    plain = F.translate(text, _HIDDEN, " ")
    shown = F.regexp_replace(plain, ANY_MATH, _HIDDEN)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = F.replace(shown, F.lit(a), F.lit(b))
    shown = F.regexp_replace(shown, r"(?s)\*\*(.+?)\*\*", "<strong>$1</strong>")
    shown = F.regexp_replace(shown, r"(?sU)(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", "<em>$1</em>")
    back = lambda x: F.array_join(F.transform(F.split(x["shown"], _HIDDEN), lambda p, i: F.concat(p, F.coalesce(F.get(x["math"], i), F.lit("")))), "")
    return bound(back, shown=shown, math=F.regexp_extract_all(plain, F.lit(ANY_MATH), F.lit(0)))


def is_row(line: Column) -> Column:
    return strip(line).startswith("|")


def cells(row: Column) -> Column:
    """The cells of a pipe table's row; an escaped bar stands in its cell."""
    row = F.regexp_replace(strip(row), r"^\|", "")
    row = F.regexp_replace(row, r"(?<!\\)\|$", "")
    return F.transform(F.split(row, r"(?<!\\)\|"), lambda c: strip(c))


def table_html(rows: Column, centred: bool = True) -> Column:
    """A pipe table (its lines) as HTML. Cells are centred but where the line under the
    head says otherwise."""
    ruled = F.coalesce(F.get(rows, F.lit(1)).rlike(r"^\s*\|?[\s:\-|]+\|?\s*$"), F.lit(False))
    side = lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.endswith(":"), "right").when(c.startswith(":"), "left").otherwise("center")
    sides = F.when(ruled, F.transform(cells(F.get(rows, F.lit(1))), side)).otherwise(F.array().cast("array<string>"))

    def line(tag: str, row: Column, sides: Column) -> Column:
        cell = lambda c, i: F.concat(F.lit(f'<{tag} style="text-align: '), F.coalesce(F.get(sides, i), F.lit("center")), F.lit(';">'), inline_html(c), F.lit(f"</{tag}>"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(row), cell), ""), F.lit("</tr>"))

    def whole(x: Column) -> Column:
        body = F.array_join(F.transform(F.slice(x["rows"], x["first"], F.greatest(F.size(x["rows"]), F.lit(1))), lambda r: line("td", r, x["sides"])), "")
        return F.concat(F.lit((TABLE if centred else "<table>") + "<thead>"), line("th", F.get(x["rows"], F.lit(0)), x["sides"]), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))

    return bound(whole, rows=rows, sides=sides, first=F.when(ruled, 3).otherwise(2))


def figures_html(block: Column) -> Column:
    """The figures of a block in one centred paragraph."""
    found = F.arrays_zip(F.regexp_extract_all(block, F.lit(FIGURE), F.lit(1)).alias("alt"), F.regexp_extract_all(block, F.lit(FIGURE), F.lit(2)).alias("name"))
    image = lambda f: F.concat(F.lit('<img src="figura:'), f["name"], F.lit('" alt="'), escape_html(f["alt"]), F.lit('">'))
    return F.concat(F.lit(PARAGRAPH), F.array_join(F.transform(found, image), " "), F.lit("</p>"))


def blocks(text: Column) -> Column:
    """Paragraphs; a table and text that touch are blocks of their own."""
    mark = lambda rows: F.array_join(F.transform(rows, lambda x, i: F.concat(F.when((i > 0) & (is_row(x) != is_row(F.get(rows, i - 1))), _CUT).otherwise(""), x)), "\n")
    parts = F.split(F.regexp_replace(text, r"^\n+|\n+$", ""), r"\n\s*\n")
    found = F.flatten(F.transform(parts, lambda p: F.split(once(F.split(p, "\n"), mark), f"\n{_CUT}")))
    return F.filter(found, lambda b: strip(b) != "")


def _rows(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda x: strip(x) != "")


def _centred(block: Column) -> Column:
    def shown(x: Column) -> Column:
        lines = F.array_join(F.transform(x["rows"], lambda r: inline_html(strip(r))), "<br>")
        return (
            F.when(F.forall(x["rows"], is_row), table_html(x["rows"]))
            .when(x["block"].rlike(ONLY_FIGURES), figures_html(x["block"]))
            .when(F.ltrim(F.get(x["rows"], F.lit(0))).startswith("<"), F.array_join(x["rows"], "\n"))
            .otherwise(F.concat(F.lit(PARAGRAPH), lines, F.lit("</p>")))
        )

    return bound(shown, block=block, rows=_rows(block))


def centre(text: Column, centred_figures: Column | None = None) -> Column:
    """Blocks marked as centred in HTML; all tables, and figures whose names are all in
    centred_figures (an array), are centred wherever they stand."""
    known = F.array().cast("array<string>") if centred_figures is None else F.coalesce(centred_figures, F.array().cast("array<string>"))
    marked = lambda body: F.concat(F.lit("\n\n"), F.array_join(F.transform(blocks(body), _centred), "\n\n"), F.lit("\n\n"))
    join = lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(marked(F.get(x["bodies"], i)), F.lit("")))), "")
    opened = bound(join, parts=F.split(text, CENTRED_BLOCK), bodies=F.regexp_extract_all(text, F.lit(CENTRED_BLOCK), F.lit(1)))

    def shown(b: Column) -> Column:
        names = F.regexp_extract_all(b, F.lit(FIGURE), F.lit(2))
        figures = b.rlike(ONLY_FIGURES) & (F.size(F.array_except(names, known)) == 0)
        return once(_rows(b), lambda rows: F.when(F.forall(rows, is_row), table_html(rows)).when(figures, figures_html(b)).otherwise(b))

    return F.when(text == "", text).otherwise(F.array_join(F.transform(blocks(opened), shown), "\n\n"))


def normalise(text: Column, centred_figures: Column | None = None) -> Column:
    """All formatting of statements and options: references, centring, tables apart."""
    return separate_tables(centre(format_references(text), centred_figures))
