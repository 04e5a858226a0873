"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns propose more
candidates. Labelers vote on each candidate: its pattern, gazetteers, its context and
its shape. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, and so how likely each candidate is personal data; a logistic
classifier is trained on these likelihoods, and candidates it accepts are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive runs and look-behinds match the same as the plain
#: forms, in time linear in the text.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What candidates look like: disguised addresses, foreign separators, no plus sign.
LOOSE = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}\p{N}-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}\p{N}-]++)++",
    r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9.])",
    r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}(?:[\x20./_-][0-9]{1,3})?(?![0-9])",
    r"(?<![0-9+])(?:00[\x20]?[1-9][0-9]{0,2}[\x20./-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])",
)
#: Words before a span that speak for its kind, and for anything but personal data.
CUES = (r"(?iu)e-?mail|contact|write|correo|courriel|adresse", r"(?iu)\bip\b|host|server|address|login|adresse", r"(?iu)card|visa|credit|carte|tarjeta|karte|pay", r"(?iu)phone|\btel\b|call|fax|mobile|telefon|tél")
AGAINST = r"(?iu)version|release|isbn|issn|order|page|section|figure|chapter|invoice|seite|\bno\.|[$€£#]\s*$"
#: Gazetteers: domain endings, nets not of persons, card issuers, calling codes.
ENDINGS = r"(?iu)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|be|ca|us|br|mx)$"
NO_PERSON = r"^0*(?:0|127|255|22[4-9]|23[0-9])[^0-9]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
CODES = r"^(?:\+|00\s?)(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
BYTES = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Words that say whose the data is.
OWN = r"(?iu)\b(?:my|our|your|his|her|mein|meine|ihre|mi|su|mon|ma|votre)\b"
FEATURES = 5
#: Characters of context on either side.
CONTEXT = 32
LABELERS = 4


def _digits(c: str = "m") -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn() -> Column:
    return F.call_function("luhn_check", _digits())


def _by_kind(values: list[Column]) -> Column:
    out = F.when(F.col("kind") == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col("kind") == k, v)
    return out


def _span_maker(pieces: str, tier: int, kind: int):
    """What transform() makes of match x, the i-th, which stands behind the i-th piece."""

    def span(x: Column, i: Column) -> Column:
        gap, after = F.get(pieces, i), F.get(pieces, i + 1)
        return F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), i.alias("k"), x.alias("m"), F.char_length(gap).cast("long").alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    return span


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per match of any pattern, and one for each text without: rid, doc_id,
    kind, tier (0 base, 1 loose), k, m, gap (letters since the match before), before, after."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("rid", F.monotonically_increasing_id())
    mail = F.col("t").contains("@")
    disguised = mail | F.col("t").rlike(r"[(\[]at[)\]]")
    digit = F.col("t").rlike("[0-9]")
    plus = F.col("t").rlike(r"\+[0-9]")
    when = {(0, 0): mail, (0, 1): digit, (0, 2): digit, (0, 3): plus, (1, 0): disguised, (1, 1): digit, (1, 2): digit, (1, 3): digit}
    parts = []
    for (tier, kind), possible in when.items():
        pattern = (BASE, LOOSE)[tier][kind]
        p = f"p{tier}{kind}"
        rows = rows.withColumn(p, F.when(possible, F.split("t", pattern, -1)))
        matches = F.when(F.size(p) > 1, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))

        parts.append(F.transform(matches, _span_maker(p, tier, kind)))
    parts = [F.when(x.isNotNull(), x).otherwise(F.array()) for x in parts]
    return rows.select("rid", "doc_id", F.inline_outer(F.concat(*parts)))


def _valid() -> Column:
    """The tests of the base kinds."""
    n = F.length(_digits())
    return _by_kind([F.lit(True), F.col("m").rlike(f"^{BYTES}(?:\\.{BYTES}){{3}}$"), n.between(14, 19) & _luhn(), n.between(10, 15)])


def _votes() -> list[Column]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    bare = F.regexp_replace(F.regexp_replace("m", r"[\[(](?:dot|\.)[\])]|\x20?\.\x20?", "."), r"\x20?(?:[\[(]at[\])]|@)\x20?", "@")
    octets = F.regexp_replace("m", r"[\[\]()]", "").rlike(f"^{BYTES}(?:\\.{BYTES}){{3}}$")
    n = F.length(_digits())
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, yes).when(bad, no).otherwise(none)

    pattern = _by_kind([vote(bare.rlike(f"^{BASE[0]}$"), F.lit(False)), vote(octets, ~octets), vote(_luhn(), ~_luhn()), vote(F.col("m").rlike(r"^00|^\([0-9]{3}\)"), F.col("m").rlike("/"))])
    gazetteer = _by_kind([vote(bare.rlike(ENDINGS), F.lit(False)), vote(F.lit(False), F.col("m").rlike(NO_PERSON)), vote(_digits().rlike(ISSUERS), ~_digits().rlike(ISSUERS)), vote(F.col("m").rlike(CODES), F.col("m").rlike(r"^(?:19|20)[0-9]{2}[./-]"))])
    cue = _by_kind([F.col("before").rlike(c) for c in CUES])
    context = vote(cue, F.col("before").rlike(AGAINST))
    dull = _digits().rlike(r"^([0-9])\1*$") & (F.col("kind") > 0)
    shape = _by_kind([vote(F.length("m").between(6, 80), F.length("m") > 80), vote(F.lit(False), dull), vote(n.between(14, 19) & ~dull, dull), vote(n.between(10, 15) & ~dull, (n < 9) | dull)])
    return [F.coalesce(v, none).cast("int") for v in (pattern, gazetteer, context, shape)]


def estimate_reliability(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count): labelers vote independently
    given the truth; how they vote on true and on false candidates and the share of
    true ones are estimated for each kind. Returns P(true) by kind and votes."""
    posterior = {}
    for kind in {k for k, _, _ in counts}:
        own = [(v, c) for k, v, c in counts if k == kind]
        truth = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in own]
        for _ in range(rounds):
            n1 = sum(t * c for t, (_, c) in zip(truth, own)) + 1
            n0 = sum((1 - t) * c for t, (_, c) in zip(truth, own)) + 1
            # Smoothing: a labeler is taken to be somewhat better than chance.
            table = []
            for j in range(LABELERS):
                p = {1: {1: 2.0, 0: 2.0, -1: 0.5}, 0: {1: 0.5, 0: 2.0, -1: 2.0}}
                for t, (v, c) in zip(truth, own):
                    p[1][v[j]] += t * c
                    p[0][v[j]] += (1 - t) * c
                table.append({y: {x: q / sum(p[y].values()) for x, q in p[y].items()} for y in p})
            new = []
            for v, _ in own:
                odds = math.log(n1 / n0) + sum(math.log(table[j][1][v[j]] / table[j][0][v[j]]) for j in range(LABELERS))
                new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            moved = max(abs(a - b) for a, b in zip(truth, new))
            truth = new
            if moved < 1e-6:
                break
        posterior |= {(kind, v): t for t, (v, _) in zip(truth, own)}
    return posterior


def fit_classifier(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on (features, P(true), count), by gradient steps; the last
    weight is the intercept."""
    width = len(rows[0][0]) if rows else 0
    w = [0.0] * (width + 1)
    total = sum(math.sqrt(c) for _, _, c in rows)
    for _ in range(steps):
        g = [-ridge * x for x in w]
        for x, p, c in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x))
            d = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * math.sqrt(c) / total
            for i, a in enumerate(x):
                g[i] += d * a
            g[-1] += d
        w = [a + rate * 4 * b for a, b in zip(w, g)]
    return w


def _feature_columns() -> list[Column]:
    """Features of a candidate's span and context that no labeler looks at."""
    return [
        F.col("after").rlike(r"^[\s,.;:!?)]|^$").cast("int"),
        F.col("before").rlike(r"[\s(:<\"]$|^$").cast("int"),
        F.col("before").rlike(r":\s?$").cast("int"),
        F.col("before").rlike(OWN).cast("int"),
        (F.char_length("m") >= 18).cast("int"),
    ]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row
    per row of docs.

    The counts and base_sha256 (of kind:start:end, by start, then kind, comma-joined)
    are of the base spans; spans lists these and the added ones in the same way.
    Offsets count code points, ends are exclusive. A candidate is added if the
    classifier gives it at least `accept` and it overlaps no base span and no accepted
    candidate before it (by start, kind and end). Texts of any length are read whole.

    Null texts count as empty: no spans. Null and repeated ids are carried through, row
    by row. An empty table gives no rows. Other columns are ignored. The driver gets
    counts of vote patterns only, a few hundred rows whatever the input.
    """
    found = materialize(_found(docs, id_col, text_col), "pii")
    counted = found.where("tier = 1").select("kind", F.array(*_votes()).alias("v"), F.array(*_feature_columns()).alias("f"))
    counts = [(r["kind"], tuple(r["v"]), tuple(r["f"]), r["count"]) for r in counted.groupBy("kind", "v", "f").count().collect()]
    merged: dict = {}
    for kind, v, _, c in counts:
        merged[kind, v] = merged.get((kind, v), 0) + c
    truth = estimate_reliability([(kind, v, c) for (kind, v), c in sorted(merged.items())])
    width = 2 * LABELERS + FEATURES + len(KINDS)

    def features(kind: int, v: tuple, f: tuple) -> list[float]:
        return [float(x > 0) for x in v] + [float(x < 0) for x in v] + [float(x) for x in f] + [float(kind == k) for k in range(len(KINDS))]

    w = fit_classifier([(features(kind, v, f), truth[kind, v], c) for kind, v, f, c in sorted(counts)]) if counts else [0.0] * width + [-30.0]
    votes = _votes()
    z = F.lit(w[-1])
    for j, v in enumerate(votes):
        z = z + F.when(v > 0, w[j]).when(v < 0, w[LABELERS + j]).otherwise(0.0)
    for j, f in enumerate(_feature_columns()):
        z = z + f * w[2 * LABELERS + j]
    z = z + _by_kind([F.lit(w[2 * LABELERS + FEATURES + k]) for k in range(len(KINDS))])
    likely = 1 / (1 + F.exp(-z))
    run = Window.partitionBy("rid", "kind", "tier").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("m")
    spans = found.withColumn("end", F.sum(F.col("gap") + length).over(run)).withColumn("start", F.col("end") - length)
    spans = spans.withColumn("ok", F.when(F.col("tier") == 0, _valid()).when(F.col("tier") == 1, likely >= accept))
    base = F.col("ok") & (F.col("tier") == 0)
    by_start = Window.partitionBy("rid").orderBy("start")
    upto = by_start.rangeBetween(Window.unboundedPreceding, 0)
    onward = by_start.rangeBetween(0, Window.unboundedFollowing)
    spans = spans.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(upto)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(onward))
    free = F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    spans = spans.withColumn("base", F.coalesce(base, F.lit(False))).withColumn("_taken", F.coalesce(F.col("ok") & (F.col("tier") == 1) & free, F.lit(False)))
    before = F.max(F.when(F.col("_taken"), F.col("end"))).over(Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("added", F.col("_taken") & F.coalesce(before <= F.col("start"), F.lit(True)))
    span = F.struct("start", "kind", "end")
    out = spans.groupBy("rid", "doc_id").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("ours"),
        F.array_sort(F.collect_list(F.when(F.col("base") | F.col("added"), span))).alias("every"),
        F.count_if("added").alias("n_added"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("ours"), 256).alias("base_sha256"), joined("every").alias("spans"), "n_added")
