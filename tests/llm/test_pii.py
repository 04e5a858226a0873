import hashlib
import re

from itemforge.llm.pii import KINDS, estimate_reliability, find_pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
ODD = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 007.08.255.0256", "4111 1111 1111 1111 5", "4111111111111111", "+1 (523) 555-1055 +49. +4930123456789012345", "ü😀 a@b.co 4111-1111-1111-1111", None, "", "%a@b.com%c@d.org", "12@3.4.5.6", "+" * 50, "1 " * 3000, "1." * 500, "x@" * 100, "a" * 200000 + "@b.c", "+1" * 40]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d or "1"), 10 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(rows, texts):
    for i, t in texts.items():
        want = brute(t)
        assert rows[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (t or "")[:60]
        assert [rows[i][f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in want) for n in range(4)]
        assert set(filter(None, joined(want).split(","))) <= set(rows[i].spans.split(","))


def test_base_spans_equal_the_plain_patterns(spark, sf_dir):
    texts = dict(enumerate(ODD))
    rows = spark.createDataFrame([(i, t, 1, "m") for i, t in texts.items()], "doc_id long, text string, kind int, m string")
    check({r.doc_id: r for r in find_pii(rows).collect()}, texts)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check({r.doc_id: r for r in find_pii(docs).collect()}, {r.doc_id: r.text for r in docs.collect()})


def test_disguised_spans_are_added_and_free_of_base_spans(spark):
    texts = ["please contact jane (at) mail (dot) com today", "phone (523) 555-1055 now", "nothing 12 here", "a@b.com"] * 20
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].spans == "email:15:39" and rows[0].n_added == 1 and rows[0].n_email == 0
    assert rows[1].spans == "phone:6:20" and rows[2].spans == "" and rows[3].spans == "email:0:7"


def test_repeats_nulls_and_nothing(spark):
    rows = find_pii(spark.createDataFrame([(None, "a@b.com"), (1, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 1]
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliability_follows_agreement():
    counts = [(0, (1, 1, 1, 1), 50), (0, (-1, -1, -1, -1), 50), (0, (1, 1, 0, 1), 10)]
    p = estimate_reliability(counts)
    assert p[0, (1, 1, 1, 1)] > 0.9 > 0.1 > p[0, (-1, -1, -1, -1)] and p[0, (1, 1, 0, 1)] > 0.8


def test_added_spans_dont_overlap(spark):
    texts = ["my card: 4111 1111 1111 1111, thanks", "call my phone 0049 4111 1111 1111 or 1111 2222 3333 4444", "write jane (at) mail (dot) com or (523) 555-1055-1234"] * 20
    for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) or r.n_added == 0


def test_disguised_data_is_found(spark):
    """Of planted spans in forms that the base patterns miss, most are added; of look-alikes few."""
    planted = [f"You can contact me: anna{i} (at) mail{i} (dot) org any time" for i in range(40)] + [f"my phone is ({200 + i}) 555-{1000 + 7 * i} at home" for i in range(40)]
    clean = [f"see page {i} of release {i}.2 in chapter {i + 3}" for i in range(40)] + [f"order no. {1000 + i}/{2000 + i}" for i in range(40)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(planted + clean)), "doc_id long, text string")).collect()}
    assert sum(got[i].n_added > 0 for i in range(80)) >= 72
    assert sum(got[i].n_added > 0 for i in range(80, 160)) <= 8
