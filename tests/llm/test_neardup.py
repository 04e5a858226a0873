import numpy as np
import pytest
from itemforge.llm import neardup
from itemforge.llm.neardup import audit_recall, near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, part string"


def brute(rows, least=0.98):
    e = {}
    for i, v, label, *_ in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            e[i] = (label, x / np.sqrt(x @ x))
    links = {i: {j for j in e if j != i and e[i][0] == e[j][0] and len(e[i][1]) == len(e[j][1]) and e[i][1] @ e[j][1] >= least} for i in e}
    out = {}
    for i, *_ in rows:
        seen, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += links.get(j, ())
        out[i] = (len(links.get(i, ())), min(seen))
    return out


def clusters(seed, labels, groups, size, alone, d=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in range(labels):
        for _ in range(groups):
            c = rng.standard_normal(d)
            for _ in range(size):
                v = c + rng.standard_normal(d) * 0.14 * np.linalg.norm(c) / np.sqrt(d)
                rows.append((i, v.astype(np.float32).tolist(), label, "x", "y"))
                i += 1
        for _ in range(alone):
            rows.append((i, rng.standard_normal(d).astype(np.float32).tolist(), label, "x", "y"))
            i += 1
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = clusters(0, 2, 3, 6, 60) + [(9000 + i, *r[1:]) for i, r in enumerate(clusters(1, 1, 1, 90, 10))]
    v = rows[0][1]
    rows += [(500, v, 0, "", ""), (501, v, None, "", ""), (502, None, 0, "", ""), (503, [0.0] * 16, 0, "", ""), (504, [float("nan")] * 16, 0, "", ""), (505, [None, *v[1:]], 0, "", ""), (506, [], 0, "", ""), (507, v[:5], 0, "", ""), (508, [float("inf")] * 16, 0, "", "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_repeats_nulls_and_nothing(spark):
    rows = [(None, [1.0, 2.0], 1, "", ""), (4, [1.0, 2.0], 1, "", ""), (4, [1.0, 2.0], 1, "", ""), (5, [2.0, 4.0], 1, "", "")]
    got = sorted(map(repr, [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]))
    assert got == sorted(map(repr, [(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (5, 3, 4, False)]))
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def bridged(seed, pairs, size, d=32):
    """Pairs of large groups of different near copies; one vector of each makes the only link between them."""
    rng = np.random.default_rng(seed)
    rows = []

    def turned(a, b, angle):
        b = b - a * (a @ b)
        return np.cos(angle) * a + np.sin(angle) * b / np.linalg.norm(b)

    for _ in range(pairs):
        a = rng.standard_normal(d)
        a /= np.linalg.norm(a)
        b = turned(a, rng.standard_normal(d), 0.47)
        for one, other in ((a, b), (b, a)):
            rows += [turned(one, rng.standard_normal(d), 0.1) for _ in range(size)]
            rows.append(turned(one, other, 0.15))
    return [(i, v.astype(np.float32).tolist(), 1, "x", "y") for i, v in enumerate(rows)]


def test_one_link_between_large_groups(spark):
    rows = bridged(5, 8, 150)
    x = np.array([r[1] for r in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n_links = (x @ x.T >= 0.98).sum(1) - 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n_links[i], i - i % 302) for i in range(len(rows))}


def test_audit_sees_what_small_groups_miss(spark):
    rng = np.random.default_rng(2)
    hot, few = rng.standard_normal(32), rng.standard_normal((3, 32))
    near = lambda c: c + 0.02 * rng.standard_normal(32)
    x = [near(hot) for _ in range(200)] + [near(c) for c in few for _ in range(2)]
    names = [bytes([i // 256, i % 256]) for i in range(len(x))]
    vecs = spark.createDataFrame([("1:32", n, bytearray((v / np.linalg.norm(v)).tobytes())) for n, v in zip(names, x)], "part string, node binary, x binary")
    comps = spark.createDataFrame([(n, names[0]) for n in names[:200]], "node binary, comp binary")
    assert audit_recall(vecs, comps, 0.98) == 0
    every = comps.unionByName(spark.createDataFrame([(names[i], names[i - i % 2]) for i in range(200, 206)], "node binary, comp binary"))
    assert audit_recall(vecs, every, 0.98) == 1
