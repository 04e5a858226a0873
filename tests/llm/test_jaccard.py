import random
import re

import itemforge.llm.jaccard as J
import pytest
from itemforge.llm.jaccard import drop_similar, runs_for, shingle_sets, similar_documents

DOCS = "doc_id long, text string, node string, size string"


def sets_of(docs, n=5):
    out = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        k = min(n, len(w))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    return out


def brute(docs, least=0.8):
    s = sets_of(docs)
    links = {i: {j for j in s if j != i and s[i] and s[j] and len(s[i] & s[j]) >= least * len(s[i] | s[j]) - 1e-9} for i in s}
    comp = {}
    for i in sorted(s):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return {i: (comp[i], len(links[i])) for i in s}


def near_copies(seed, groups, members, words=120):
    rng = random.Random(seed)
    docs, i = [], 0
    for _ in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(words)] = "x" + str(rng.randrange(99))
            docs.append((i, " ".join(w)))
            i += 1
    return docs


@pytest.mark.parametrize("bucket", [4096, 8])
def test_equals_brute_force(spark, monkeypatch, bucket):
    """With small buckets paths get longer and blocks are paired."""
    monkeypatch.setattr(J, "BUCKET", bucket)
    monkeypatch.setattr(J, "BLOCK_SETS", bucket)
    docs = near_copies(1, 6, 14) + [(500, "a b c"), (501, "A, b: c!"), (502, "a b d"), (600, None), (601, ""), (602, "..."), (603, "é ü ß ñ o"), (604, "É Ü ß Ñ o")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_documents(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)).collect()}
    assert got == brute(docs)
    assert got[501] == (500, 1) and got[600] == (600, 0)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "one two three four five six", "", ""), (3, "one two three four five six", "", ""), (3, "one two three four five six", "", ""), (3, "other words that are not the same", "", "")]
    got = sorted(map(repr, [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in similar_documents(spark.createDataFrame(rows, DOCS)).collect()]))
    assert got == sorted(map(repr, [(None, 3, 2, 2), (3, 3, 2, 2), (3, 3, 2, 2), (3, 3, 0, 0)]))
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = near_copies(2, 3, 5)
    out = drop_similar(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS))
    assert out.columns == ["doc_id", "text", "node", "size"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (c, _) in brute(docs).items() if c == i)


def test_runs_reach_the_recall():
    assert runs_for(0.9, 0.8) < runs_for(0.9999, 0.8) <= 6
    sets, offsets = shingle_sets(["a b c d e f", "", None, "a"], 5)
    assert offsets.tolist() == [0, 2, 2, 2, 3] and len(sets) == 3


def test_paths_of_a_run_miss_apart(spark, monkeypatch):
    """One run with every bucket split: a pair is missed with 0.12, not with 0.25."""
    monkeypatch.setattr(J, "BUCKET", 1)
    monkeypatch.setattr(J, "runs_for", lambda *_: 1)
    rng = random.Random(4)
    docs = []
    for i in range(600):
        w = [f"v{rng.randrange(10**6)}" for _ in range(104)]
        docs += [(2 * i, " ".join(w), "x", "y"), (2 * i + 1, " ".join(w[:85]), "x", "y")]
    found = similar_documents(spark.createDataFrame(docs, DOCS)).where("n_links = 1").count()
    assert found >= 2 * 600 * 0.82


def test_runs_hold_the_bound_when_all_levels_split():
    for recall, similarity in ((0.9, 0.8), (0.9999, 0.8), (0.999, 0.5)):
        missed = 0.0
        for _ in range(J.LEVELS):
            missed = 2.718281828 ** (-J.CHOSEN * similarity * (1 - missed))
        assert missed ** runs_for(recall, similarity) <= 1 - recall


def test_rows_that_share_an_id_are_apart(spark):
    first, near = "one two three four five six", [f"w{i}" for i in range(60)]
    rows = [(1, first), (3, first), (3, "other words that are not the same"), (None, first), (None, "none of these has an id"), (None, "nor has this one, which differs")]
    rows += [(7, " ".join(near))] * 2 + [(7, " ".join([*near[:-1], "x"])), (None, None), (None, None)]
    rows = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = sorted((repr(r.doc_id), r.text or "") for r in drop_similar(rows).collect())
    assert [g for g in got if g[0] != "7"] == sorted([("1", first), ("3", "other words that are not the same"), ("None", "none of these has an id"), ("None", "nor has this one, which differs"), ("None", ""), ("None", "")])
    assert sum(g[0] == "7" for g in got) == 1
    assert similar_documents(rows).where("kept and class_id = 7").count() == 1


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.7, 0.8])
def test_sketches_lose_no_pair_at_any_similarity(spark, similarity):
    """Pairs just above the similarity: as many as there are, all are found."""
    rng = random.Random(int(similarity * 100))
    docs, words = [], 300
    for pair in range(150):
        base = [f"p{pair}w{k}" for k in range(words)]
        other = list(base)
        # Each run of changed words changes 4 grams more than it has words.
        keep = int((words - 4) * 2 * (similarity + 0.012) / (1 + similarity + 0.012)) + 5
        other[keep:] = [f"o{pair}w{k}" for k in range(words - keep)]
        docs += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    rng.shuffle(docs)
    want = brute(docs, similarity)
    assert sum(n for _, n in want.values()) == 300
    got = similar_documents(spark.createDataFrame([(i, t, "", "") for i, t in docs], DOCS), similarity=similarity).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want


def test_cuts_follow_the_similarity():
    assert J.sketch_cut(0.9999, 0.8) == 15 and J.runs_for(1 - 0.9e-4, 0.8) == 5
    cuts = [J.sketch_cut(0.9999, s) for s in (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)]
    assert cuts == sorted(cuts) and cuts[0] == 0 and cuts[-1] == J.SKETCH


def test_rows_without_ids_cost_what_others_do(spark):
    """Texts of sets are found by id and hash: n rows without an id don't meet n sets each."""
    docs = [t for _, t in near_copies(7, 40, 20, words=60)]
    got = similar_documents(spark.createDataFrame([(None, t, "", "") for t in docs], DOCS)).collect()
    want = brute(list(enumerate(docs)))
    assert sorted(r.n_links for r in got) == sorted(n for _, n in want.values())


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    """A round more only to see that nothing changes is tasks for nothing, and so are links in chains."""
    import itemforge.llm.common as C

    written, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(name) or write(df, name))
    stars = [(10 * k + i, 10 * k) for k in range(5) for i in range(1, 9)]
    got = {r.node: r.comp for r in C.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(50) if i % 10 < 9} and len(written) == 2
    rng = random.Random(5)
    order = rng.sample(range(300), 300)
    chains = [e for k in range(0, 300, 60) for e in zip(order[k : k + 60], order[k + 1 : k + 60])]
    got = {r.node: r.comp for r in C.connected_components(spark.createDataFrame(chains + chains[:9], "a long, b long")).collect()}
    assert got == {i: min(order[k : k + 60]) for k in range(0, 300, 60) for i in order[k : k + 60]}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    ties = J._Union(5)
    ties.tie(1, 3), ties.tie(3, 4)
    assert ties.stars([b"e", b"d", b"c", b"b", b"a"]) == [(b"d", b"a"), (b"b", b"a")]
