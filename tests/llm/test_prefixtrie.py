import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from itemforge.llm import prefixtrie
from itemforge.llm.prefixtrie import PRIME, conversation_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string"


def brute(rows):
    """The nodes by whole sequences of turns."""
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for v in own.values():
        v.sort()
    turns = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        turns[c] = [x[2:] for x in own.get(first, [])[:h]] + [x[2:] for x in own[c][h:]]
    members, below = defaultdict(list), defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        sums[p] = (sum(sums[k][0] for k in below[p]) or 1, saved + sum(sums[k][1] for k in below[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(turns[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def odd_rows():
    rng = random.Random(5)
    texts = ["", None, "a b", "a  b", "é ü", "long " * 3000, "x"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), "d", "f") for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", "same first turn", "d", "f") for c in range(100, 160) for t in range(rng.randint(1, 3))]  # copies
    rows += [(200, None, "user", "null turn", "d", "f"), (200, 3, None, None, "d", "f"), (200, 3, None, None, "d", "f")]  # a null turn, a tie
    rows += [(None, 1, "user", "nowhere", "d", "f"), (-5, 0, "user", "x", "d", "f"), (-5, 1, "user", "y", "d", "f"), (-40, 0, "user", "z", "d", "f")]
    rows += [(300 + k, 0, "user", "short", "d", "f") for k in range(1, 8)]  # their first, 300, is not there
    rows += [((1 << 63) - 5, 0, "user", "at the end", "d", "f")]
    return rows


@pytest.mark.parametrize("bits", [60, 2])
def test_equals_whole_sequences(spark, bits):
    """With hashes of two bits nearly all groups hold several prefixes, which have to be split."""
    rows = odd_rows()
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), bits).collect()
    assert key(got) == key(brute(rows))


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert key(conversation_trie(df).collect()) == key(brute(df.collect()))


def test_a_conversation_in_many_tasks(spark):
    """A hot conversation is dealt by its turns; sums go over its blocks."""
    rows = [(20, t, "user", f"w{t} v" if t != 5000 else "w", "d", "f") for t in range(9000)] + [(c, t, "user", f"w{t} v", "d", "f") for c in (40, 60) for t in range(4500)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = prefixtrie.prefixes(prefixtrie.rebuilt(df), [F.col("ord")], "t").where("depth > 0")
        parts = df.repartitionByRange("conv_id", "turn").select("conv_id", F.spark_partition_id().alias("p")).distinct().groupBy("conv_id").count()
        assert parts.agg(F.max("count")).first()[0] > 1
        assert dealt.select("conv_id", "depth").distinct().count() == len(rows)
        check_many_tasks(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_many_tasks(df):
    got, want = conversation_trie(df).select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens").collect(), []
    n = lambda d: 3 if d <= 4500 else 1
    saved = 0
    for d in range(9000, -1, -1):
        saved += (n(d) - 1) * (2 if d else 0)
        want.append((20, d, n(d), int(d < 9000), 1, saved))
    assert key(got) == key(want)


def test_no_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "d", "f")], SCHEMA)).count() == 0


def test_arithmetic_equals_whole_numbers():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, PRIME, 500, np.uint64), rng.integers(0, PRIME, 500, np.uint64)
    a[:3], b[:3] = PRIME - 1, [0, 1, PRIME - 1]
    assert prefixtrie._times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    total, want = 0, []
    for x in a:
        total = (total + int(x)) % PRIME
        want.append(total)
    assert prefixtrie._running(a).tolist() == want
    assert prefixtrie._powers(40)[:41].tolist() == [pow(prefixtrie.BASE, k, PRIME) for k in range(41)]
