"""The queries of this subpackage with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import token_digest

    return token_digest(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_roundtrip

    return bpe_roundtrip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import detect_toxicity

    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), n=5, similarity=0.8)


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard import shard_stratified

    return shard_stratified(table(spark, sf_dir, "documents"), n_shards=24)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rate_quality

    return rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_file": op2_token_file,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op5_pii": op5_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_sharding": op8_sharding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_quality": op12_quality,
    "op13_lexical_search": op13_lexical_search,
}

def _op1_sql() -> str:
    from .decontaminate import AFTER, BEFORE, MASKS, PART, SHORT_ITEM, SUBSTITUTIONS, WINDOW

    masks = [*enumerate(MASKS), ("p", tuple(range(PART))), *[(f"w{n}", tuple(range(n))) for n in range(1, SHORT_ITEM)]]
    seed = lambda j, m, also: f"SELECT key, i, n, t, concat_ws(' ', '{j}', {', '.join(f't[i + {k + 1}]' for k in m)}) AS seed FROM {{0}} WHERE i + {m[-1]} < n{also}"
    # An item takes the masks that its length asks for; a document is looked up by all.
    own = lambda j, m: f" AND n = {len(m)} AND i = 0" if str(j)[0] == "w" else f" AND n >= {SHORT_ITEM}" + (f" AND n < {WINDOW}" if j == "p" else "")
    of_docs = " UNION ALL ".join(seed(j, m, "") for j, m in masks)
    of_items = " UNION ALL ".join(seed(j, m, own(j, m)) for j, m in masks)
    return rf"""
WITH d AS (SELECT doc_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS t FROM documents),
b AS (SELECT item_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS t FROM benchmark),
dp AS (SELECT key, t, len(t) AS n, unnest(range(len(t))) AS i FROM d),
bp AS (SELECT key, t, len(t) AS n, unnest(range(len(t))) AS i FROM b),
ds AS ({of_docs.format("dp")}),
bs AS ({of_items.format("bp")}),
h AS (SELECT ds.key AS doc_id, bs.key AS item_id, ds.i AS doc_token, bs.i AS item_token, least(bs.n, {WINDOW}) AS window_tokens,
  list_max(list_transform(range({BEFORE + AFTER - WINDOW + 1}), lambda s: list_sum(list_transform(range({WINDOW}), lambda k:
    CASE WHEN ds.i - {BEFORE} + s + k >= 0 AND bs.i - {BEFORE} + s + k >= 0 AND ds.t[ds.i - {BEFORE} + s + k + 1] = bs.t[bs.i - {BEFORE} + s + k + 1] THEN 1 ELSE 0 END)))) AS n_match
  FROM ds JOIN bs USING (seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_match DESC, doc_token, item_token, window_tokens) AS rn
  FROM h WHERE n_match >= window_tokens - CASE WHEN window_tokens < {SHORT_ITEM} THEN 0 ELSE ({SUBSTITUTIONS} * window_tokens) // {WINDOW} END)
SELECT doc_id, item_id, CAST(n_match AS INTEGER) AS n_match, CAST(window_tokens AS INTEGER) AS window_tokens, CAST(doc_token AS INTEGER) AS doc_token, CAST(item_token AS INTEGER) AS item_token FROM r WHERE rn = 1"""


#: The letters are those of linededup.UNSPACED.
_OP9_SQL = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM x),
w AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(lower(regexp_replace(line, '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g')), '\s+'), lambda s: s <> '') AS w FROM l),
f AS (SELECT w, len(w) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM w WHERE len(w) >= 1 GROUP BY w),
h AS (SELECT w, n, first, unnest([{'s': 0, 'c': n, 'h': w[1:n // 2]}, {'s': 1, 'c': n, 'h': w[n // 2 + 1:]},
  {'s': 0, 'c': n - 1, 'h': w[1:(n - 1) // 2]}, {'s': 1, 'c': n - 1, 'h': w[(n - 1) // 2 + 2:]}]) AS half FROM f WHERE n >= 8),
near AS (SELECT DISTINCT a.w FROM h a JOIN h b ON a.half = b.half AND b.first < a.first WHERE
  CASE WHEN a.n = b.n THEN list_sum(list_transform(list_zip(a.w, b.w), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 1
    WHEN a.n > b.n THEN len(list_filter(range(a.n), lambda i: list_concat(a.w[1:i], a.w[i + 2:]) = b.w)) > 0
    ELSE len(list_filter(range(b.n), lambda i: list_concat(b.w[1:i], b.w[i + 2:]) = a.w)) > 0 END),
kept AS (SELECT w.doc_id, w.line_no, w.line, NOT coalesce(near.w IS NOT NULL OR {'d': w.doc_id, 'l': w.line_no} > f.first, false) AS keep
  FROM w LEFT JOIN f ON w.w = f.w LEFT JOIN near ON w.w = near.w)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE keep), '') END AS text,
  count(line_no) AS n_lines, count(line_no) FILTER (WHERE NOT keep) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id, d.text"""

_OP7_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, least(x.vec_id, coalesce(r.least, x.vec_id)) AS component_id, x.vec_id = least(x.vec_id, coalesce(r.least, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = x.vec_id LEFT JOIN r ON r.a = x.vec_id"""

#: Words are runs of letters, digits and underscores; links come from the shingles that two different sets share.
_OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT md5(array_to_string(s, '|')) AS node, any_value(s) AS s, count(*) AS copies, min(doc_id) AS least FROM g WHERE len(s) > 0 GROUP BY 1),
t AS (SELECT node, len(s) AS n, unnest(s) AS x FROM n),
e AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.x = b.x AND a.node <> b.node AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT n.node, n.copies, least(n.least, coalesce((SELECT min(m.least) FROM r JOIN n m ON m.node = r.b WHERE r.a = n.node), n.least)) AS class_id, coalesce((SELECT sum(m.copies) FROM e JOIN n m ON m.node = e.b WHERE e.a = n.node), 0) AS links FROM n)
SELECT g.doc_id, coalesce(c.class_id, g.doc_id) AS class_id, CAST(coalesce(c.links + c.copies - 1, 0) AS BIGINT) AS n_links, coalesce(c.copies - 1, 0) AS n_copies, g.doc_id = coalesce(c.class_id, g.doc_id) AS kept
FROM g LEFT JOIN c ON len(g.s) > 0 AND c.node = md5(array_to_string(g.s, '|'))"""

#: A CRC-32 goes through the bytes of the decimal id and eight steps after each.
_OP11_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT conv_id, p, role, text FROM o JOIN c USING (conv_id) WHERE p >= h UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE p < h),
s AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM s),
n AS (SELECT s[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '') AS ends FROM m GROUP BY 1, 2),
k AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.k[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON n.k = k.k),
u AS (SELECT k[1:d] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u ON u.k = w.k LEFT JOIN n p ON w.depth > 0 AND p.k = w.k[1:w.depth - 1]"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": _OP6_SQL, "op7_embedding_neardup": _OP7_SQL, "op1_decontamination": _op1_sql(), "op9_line_dedup": _OP9_SQL, "op11_conversation_trie": _OP11_SQL, "op13_lexical_search": _OP13_SQL}
