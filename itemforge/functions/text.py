"""Column functions on text: Markdown with LaTeX, and the source text of questions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Symbols that belong in formulas, commands that the display lacks.
MATH_SYMBOLS = "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉√≤≥≠±×÷∞∫∑πΔ≈"
UNSUPPORTED = ("\\ce{", "\\SI{", "\\usepackage", "\\begin{document}")
# Letters with marks and the letters that they are compared as.
MARKED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"

# What a formula is, how centred lines are marked, figures named and questions begun.
MATH = r"(?s)\$\$.+?\$\$|\$.+?\$"
CENTRED_MARK = "[centralizado] "
CENTRED_HEAD = r"^\[centralizado\] "
FIGURE_REF = r"(?:!\[[^\]]*\]\(|src=\")figura:([A-Za-z0-9_]+)"
QUESTION_BAR = r"(?iu)^\s*quest[aã]o\s*(\d[\d ]*)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: what stands in the body of a lambda is
    evaluated anew for each element, the variable of a lambda around it is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bound(use: Callable[[Column], Column], **values: Column) -> Column:
    """once() for several values, the fields of the variable."""
    return once(F.struct(*[v.alias(k) for k, v in values.items()]), use)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines() has them: no empty one after a last line end."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0B\x0C\x85  ])$", ""), r"\R")


def fold(text: Column) -> Column:
    """Lower case without the common marks: the JVM form of decompose()."""
    return F.translate(F.lower(text), MARKED, PLAIN)


@F.pandas_udf(T.StringType())
def decompose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case, compatibility decomposition, combining marks dropped."""
    import unicodedata

    def one(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))

    for part in parts:
        yield part.map(one)


def key(text: Column, exact: bool = False) -> Column:
    """What is compared of a text: small letters and digits, without LaTeX commands, tags and marks."""
    plain = F.regexp_replace(text, r"\\[a-zA-Z]+|<[^>]+>", " ")
    return F.regexp_replace(decompose(plain) if exact else fold(plain), "[^a-z0-9]", "")


# LaTeX


def unescaped(text: Column) -> Column:
    """Without escaped dollar signs."""
    return F.replace(text, F.lit("\\$"), F.lit(""))


def without_math(text: Column) -> Column:
    return F.regexp_replace(unescaped(text), MATH, " ")


def formulas(text: Column) -> Column:
    return F.regexp_extract_all(unescaped(text), F.lit(MATH), F.lit(0))


def count_of(text: Column, part: Column | str) -> Column:
    """How often part stands in text, without overlaps; 0 for an empty part."""
    part = F.lit(part) if isinstance(part, str) else part
    times = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, times).otherwise(0).cast("int")


def odd_dollars(text: Column) -> Column:
    return count_of(unescaped(text), "$") % 2 == 1


def money_unescaped(text: Column) -> Column:
    return unescaped(text).rlike(r"R\$\s?\d")


def unbalanced(text: Column) -> Column:
    """The formulas whose braces don't pair up."""
    return F.filter(formulas(text), lambda f: count_of(f, "{") != count_of(f, "}"))


def unsupported(text: Column) -> Column:
    """One entry for each formula and unsupported command in it."""
    return F.flatten(F.transform(formulas(text), lambda f: F.filter(F.array(*[F.lit(c) for c in UNSUPPORTED]), lambda c: F.contains(f, c))))


def symbols_outside(text: Column) -> Column:
    """The sorted distinct mathematical symbols outside formulas."""
    return F.array_sort(F.array_distinct(F.filter(F.split(without_math(text), ""), lambda c: (c != "") & (F.instr(F.lit(MATH_SYMBOLS), c) > 0))))


def latex_of_line(text: Column) -> Column:
    """An equation written as plain text, in LaTeX; empty if there is no relation in it."""
    out = F.regexp_replace(text, r"(?U)\s+", " ")
    for sign, command in (("≤", "\\le "), ("≥", "\\ge "), ("≠", "\\neq "), ("−", "-"), ("–", "-"), ("×", "\\times "), ("·", "\\cdot ")):
        out = F.replace(out, F.lit(sign), F.lit(command))
    return F.when(text.rlike("[=<>≤≥≠]"), squeeze(out)).otherwise("")


def cases_of(equations: Column) -> Column:
    """A system of equations."""
    return F.concat(F.lit("\\begin{cases} "), F.array_join(equations, " \\\\ "), F.lit(" \\end{cases}"))


# Commands whose braces hold words, and what two readings of a formula may differ in.
WORD_COMMAND = r"\\(?:operatorname|mathrm|text|mathbf)\s?\*? \{.*?\}"
NO_MATTER = r"\\[,;:! ]|\s|[{}]|\\left|\\right"


def tight_formula(latex: Column) -> Column:
    """A read formula without the spaces that part nothing: they stay between letters,
    behind a backslash and at the ends."""
    parts, words = F.split(latex, WORD_COMMAND), F.regexp_extract_all(latex, F.lit(WORD_COMMAND), F.lit(0))
    joined = lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.replace(F.coalesce(F.get(x["words"], i), F.lit("")), F.lit(" "), F.lit("")))), "")
    single = F.regexp_replace(bound(joined, parts=parts, words=words), r"\s*(\s)", "$1")
    return F.regexp_replace(single, r"(?<=[^A-Za-z\\\s])\s(?=\S)|(?<=[A-Za-z])\s(?=[^A-Za-z\s])", "")


# What braces behind it are arguments of.
ARGUMENT = r"[\^_}]$|\\(?:frac|dfrac|tfrac|sqrt|text|mathrm|mathbf|mathit|mathcal|boldsymbol|vec|hat|bar|dot|ddot|tilde|overline|underline|overrightarrow|operatorname|binom)\s*$"
_LONGEST = 64  # of a command and the blanks behind it that ARGUMENT is asked about


def _lean(s: str) -> str:
    """One formula without redundant braces, in two scans: partners and runs of groups from the
    right, then what stays from the left."""
    partner, stack = {}, []
    for i, c in enumerate(s):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            partner[stack.pop()] = i
    after = list(range(len(s) + 1))  # behind the groups that begin here
    for i in sorted(partner, reverse=True):
        after[i] = after[partner[i] + 1]
    out: list[str] = []
    gone = set()
    for i, c in enumerate(s):
        if i in gone:
            continue
        if c == "{" and s[i + 1 : i + 2] == "\\" and not re.search(ARGUMENT, "".join(out[-_LONGEST:])):
            if i not in partner:  # what follows can't be told
                return "".join(out) + "".join(x for j, x in enumerate(s[i:], i) if j not in gone)
            k = i + 2
            while s[k].isascii() and s[k].isalpha():
                k += 1
            if k > i + 2 and after[k] == partner[i]:
                gone.add(partner[i])
                continue
        out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def lean_braces(latex: pd.Series) -> pd.Series:
    """Formulas without the braces around a whole command and its arguments, where they aren't
    arguments themselves; from a brace without a partner on all stay. Null stays null."""
    return latex.map(_lean, na_action="ignore")


def reading_key(latex: Column) -> Column:
    """What two readings of a formula must share to agree."""
    return F.regexp_replace(latex, NO_MATTER, "")


# Markdown


def figure_refs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FIGURE_REF), F.lit(1))


def table_heads(text: Column) -> Column:
    """First rows of pipe tables: lines that begin with a bar, after one that doesn't."""
    is_row = lambda x: strip(x).startswith("|")
    return once(F.split(text, "\n"), lambda rows: F.filter(rows, lambda x, i: is_row(x) & ((i == 0) | ~is_row(F.get(rows, i - 1)))))


def bold_spans(text: Column) -> Column:
    """What is shown bold: marked runs, table heads of HTML and of pipe tables."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?s)\*\*(.+?)\*\*", r"(?s)<strong>(.+?)</strong>", r"(?s)<thead>(.*?)</thead>")]
    return F.concat(*found, table_heads(text))


def centred_spans(text: Column) -> Column:
    patterns = (r'(?s)<p style="text-align: center;">(.*?)</p>', r'(?s)<table style="margin-left: auto; margin-right: auto;">(.*?)</table>', r"(?s)\$\$(.*?)\$\$")
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def joined_keys(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: key(x)), "|")


def bold_marked(text: Column) -> Column:
    """text in bold marks, with the white space at its ends outside."""
    return F.regexp_replace(text, r"(?s)^(\s*)(.*?)(\s*)$", r"$1**$2**$3")


def search_text(text: Column, letters: int | None = None) -> Column:
    """text without pictures and markup, of a whole text or its first letters."""
    plain = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)|[$*_#>|\\]", " ")
    return squeeze(plain) if letters is None else F.substring(squeeze(plain), 1, letters)


def first_words(text: Column, n: int = 40) -> Column:
    return F.array_join(F.slice(F.split(strip(text), r"(?U)\s+"), 1, n), " ")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def replace_figures(text: Column, figures: Column) -> Column:
    """Each figure's reference by its url, as it stands; a name ends where its letters end."""
    url = lambda f: F.regexp_replace(f["url"], r"([\\$])", r"\\$1")  # noqa: E731  no group references
    return F.aggregate(figures, text, lambda t, f: F.regexp_replace(t, F.concat(F.lit("figura:"), f["name"], F.lit("(?![A-Za-z0-9_])")), url(f)))


# How reference paragraphs begin, what else marks one, and their markup.
REFERENCE_HEAD = r"(?iu)^\(?\s*(?:fontes?\s*(?:\([^)]*\)\s*)?:|dispon[ií]vel em|adaptad[oa] de|texto adaptado|extra[ií]d[oa] d[eo]|retirad[oa] d[eo]|imagem dispon[ií]vel|foto:|ilustra[cç][aã]o:|cr[eé]dito)"
REFERENCE_MARK = r"(?iu)acesso em\s*:|dispon[ií]vel em\s*:"
REFERENCE_OPEN, REFERENCE_CLOSE = '<p style="text-align: right;"><sub>', "</sub></p>"


def is_reference(paragraph: Column) -> Column:
    """Whether a paragraph is a source or a picture credit."""
    bare = strip(F.regexp_replace(strip(paragraph), r"^[*_]+|[*_]+$", ""))
    other = bare.startswith("<p") | bare.startswith("!") | bare.startswith("|") | bare.contains("$") | bare.contains("\n\n")
    return (bare != "") & ~other & (bare.rlike(REFERENCE_HEAD) | ((F.length(bare) < 500) & bare.rlike(REFERENCE_MARK)))


def reference_html(paragraph: Column) -> Column:
    """A reference without emphasis around it and link markup, in its standard markup."""
    bare = strip(paragraph)
    for _ in range(3):  # emphasis is at most three deep
        bare = strip(F.regexp_replace(bare, r"(?s)^(\*{1,3}|_{1,3})(.+?)\1$", "$2"))
    bare = F.regexp_replace(bare, r"<(https?://[^>\s]+)>", "$1")
    bare = F.regexp_replace(bare, r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1")
    bare = F.replace(F.replace(bare, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.regexp_extract(paragraph, r"(?U)^(\s*)", 1), F.lit(REFERENCE_OPEN), bare, F.lit(REFERENCE_CLOSE))


def format_references(text: Column) -> Column:
    """Each reference paragraph in its standard markup; what parts paragraphs stays."""
    gap = r"\n\s*\n"
    shown = lambda p: F.when(is_reference(p), reference_html(p)).otherwise(p)
    whole = lambda x: F.transform(x["parts"], lambda p, i: F.concat(F.when(i > 0, F.get(x["gaps"], i - 1)).otherwise(""), shown(p)))
    return F.array_join(bound(whole, parts=F.split(text, gap), gaps=F.regexp_extract_all(text, F.lit(gap), F.lit(0))), "")


def separate_tables(text: Column) -> Column:
    """An empty line between a pipe table and the text it touches."""
    row = lambda x: strip(x).startswith("|")

    def with_gap(rows: Column, x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(rows, i - 1), F.lit(""))
        touches = (strip(before) != "") & (strip(x) != "") & (row(x) != row(before))
        return F.concat(F.when((i > 0) & touches, "\n").otherwise(""), x)

    return F.array_join(once(F.split(text, "\n"), lambda rows: F.transform(rows, lambda x, i: with_gap(rows, x, i))), "\n")


# Numbers, titles and headers


def two_digits(n: Column) -> Column:
    return F.format_string("%02d", n)


def filled(text: Column) -> Column:
    """null for an empty text."""
    return F.nullif(text, F.lit(""))


def title(kind: Column, list_title: Column, number: Column, institution: Column, year: Column, exam: Column, day: Column, edition: int = 2026) -> Column:
    """The standard title of a question; null for a mock exam without number or day."""
    source = filled(F.concat_ws(" ", filled(institution), year.cast("string")))
    mock = F.concat(F.lit("Questão "), two_digits(number), F.lit(" - "), exam.cast("string"), F.lit(f"º Simulado Autoral {edition} - "), day.cast("string"), F.lit("º DIA"))
    return F.when(kind == "simulado", mock).otherwise(F.concat_ws(" - ", F.lit("Lista de Exercícios"), list_title, F.concat(F.lit("Questão "), two_digits(number)), source))


def exam_number(file: Column) -> Column:
    return filled(F.regexp_extract(F.translate(file, "_", " "), r"(?iu)(\d+)\s*[ºo°]?\s*Simulado", 1)).cast("int")


def exam_day(file: Column) -> Column:
    plain = F.translate(file, "_", " ")
    either = r"(?iu)(\d+)\s*[ºo°]?\s*DIA|DIA\s*(\d+)"
    return F.coalesce(filled(F.regexp_extract(plain, either, 1)), filled(F.regexp_extract(plain, either, 2))).cast("int")


def bar_line(source: Column) -> Column:
    """The line with the question's bar, else the first line."""
    rows = F.split(F.coalesce(source, F.lit("")), "\n")
    return F.coalesce(F.get(F.filter(rows, lambda x: x.rlike(r"(?iu)^\s*quest[aã]o\s*\d")), F.lit(0)), F.get(rows, F.lit(0)))


def bar_rest(source: Column) -> Column:
    """What follows the number on the bar; null if it has no two letters in a row."""
    rest = strip(F.regexp_replace(bar_line(source), r"(?iu)^\s*quest[aã]o\s*\d[\d ]*", ""))
    return F.when(rest.rlike("[A-Za-z]{2,}"), strip(F.regexp_replace(rest, r"(?iu)\(\s*adaptad[oa]\s*\)", " ")))


def bar_year(source: Column) -> Column:
    """The last of the years that a scan from the left finds."""
    return F.try_element_at(F.regexp_extract_all(bar_rest(source), F.lit(r"(?:19|20)\d{2}"), F.lit(0)), F.lit(-1)).cast("int")


def bar_institution(source: Column) -> Column:
    """What stands before that year. split() scans from the left as well, so the pieces
    before the last year and the years between them give the text back."""
    pattern = r"(?:19|20)\d{2}"

    def before_last(rest: Column) -> Column:
        years, pieces = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), F.split(rest, pattern)
        n = F.size(years)
        return F.array_join(F.transform(F.slice(pieces, 1, F.greatest(n, F.lit(1))), lambda p, i: F.when(i < n - 1, F.concat(p, F.get(years, i))).otherwise(p)), "")

    before = once(bar_rest(source), before_last)
    return filled(strip(F.regexp_replace(before, r"[\s\-–—|,/]+$", "")))


def bar_number(source: Column) -> Column:
    return filled(F.replace(F.regexp_extract(source, QUESTION_BAR, 1), F.lit(" "), F.lit(""))).cast("int")


def answer_pairs(text: Column) -> Column:
    """(number, letter) of an answer table: a number line, then a letter line. Of equal
    numbers the first counts."""
    pattern = r"(?m)^\s*(\d{1,4})\s*\n\s*([A-E])\s*$"
    return _first_pairs(text, pattern)


def inline_answers(text: Column) -> Column:
    """(number, letter) of lines of nothing but such pairs, one or several side by side. Of
    equal numbers the last counts."""
    only = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(?:\d{1,4}\s+[A-E]\s*)+$")), "\n")
    return _first_pairs(only, r"(\d{1,4})\s+([A-E])\b", F.reverse)


def _first_pairs(text: Column, pattern: str, order: Callable[[Column], Column] = lambda x: x) -> Column:
    found = [order(F.regexp_extract_all(text, F.lit(pattern), F.lit(k))) for k in (1, 2)]

    def pairs(x: Column) -> Column:
        first = lambda n: F.element_at(x["letters"], F.array_position(x["numbers"], n).cast("int"))
        return once(F.array_distinct(x["numbers"]), lambda d: F.map_from_arrays(d, F.transform(d, first)))

    return bound(pairs, numbers=F.transform(found[0], lambda n: two_digits(n.cast("int"))), letters=found[1])


# Comparison of a source with its transcription


def source_body(source: Column) -> Column:
    """The source without its bar, marks and credit lines."""
    plain = F.replace(F.replace(source, F.lit(CENTRED_MARK), F.lit("")), F.lit("**"), F.lit(""))
    rows = lines(plain)
    return F.array_join(F.filter(F.slice(rows, 2, F.size(rows)), lambda x: ~x.rlike(r"^\s*\(?(Fonte|Disponível em)")), "\n")


def numbers_missing(body: Column, transcript: Column) -> Column:
    """Numbers of two digits or more whose digits are nowhere in the transcript's."""
    numbers = F.regexp_extract_all(F.replace(body, F.lit("."), F.lit("")), F.lit(r"\d+"), F.lit(0))
    lost = lambda x: F.filter(x["numbers"], lambda n: (F.length(n) >= 2) & (F.instr(x["digits"], n) == 0))
    return bound(lost, numbers=numbers, digits=F.regexp_replace(transcript, "[^0-9]", ""))


def long_words(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(body), F.lit("[a-zà-ú]{5,}"), F.lit(0)))


def word_coverage(body: Column, transcript: Column) -> Column:
    """The share of the body's distinct long words that the transcript holds, as words or
    within them; null without any. A long word can only stand in a run of letters that is a long word
    itself, so what isn't among the transcript's distinct words is looked up in them, not in the text."""
    shared = lambda x: F.array_except(x["words"], x["others"])
    lost = lambda x: bound(lambda y: F.filter(y["open"], lambda w: F.instr(y["text"], w) == 0), open=shared(x), text=F.array_join(x["others"], " "))
    held = lambda x: (F.size(x["words"]) - F.size(lost(x))) / F.nullif(F.size(x["words"]), F.lit(0))
    return bound(held, words=long_words(body), others=F.coalesce(long_words(transcript), F.array().cast("array<string>")))


def lines_repeated(source: Column, transcript: Column, least: int = 12) -> Column:
    """Keys of the source's lines that the transcript has more often than the source."""
    body = once(lines(source), lambda rows: F.slice(rows, 2, F.size(rows)))
    keys = F.transform(body, lambda x: key(F.regexp_replace(x, CENTRED_HEAD, "")))
    more = lambda x: F.filter(F.array_distinct(x["keys"]), lambda k: (F.length(k) >= least) & (count_of(x["other"], k) > count_of(x["whole"], k)))
    return once(keys, lambda k: bound(more, keys=k, whole=F.array_join(k, ""), other=key(transcript)))


def letters_out_of_order(letters: Column) -> Column:
    """Whether a letter follows a later one after B was seen."""
    n = F.size(letters)
    return (n >= 2) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get(letters, i) < F.get(letters, i - 1)) & F.array_contains(F.slice(letters, F.lit(2), i), "B"))
