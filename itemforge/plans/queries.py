"""The operators applied to the driver's tables, each with its SQL.

Stand-ins: an import is an order, a question a line item (numbered within its order), a
virtual list a customer, discipline and topic are region and nation, a subject is a part
type, an institution a brand; documents give texts, conversations ordered segments and
events points on a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as t
from ..operators import assemble, bank, export, ordered, segment, spatial, validate, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with number, their place in the order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


_N = """n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS number FROM lineitem)"""


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{t.MARKED}', '{t.PLAIN}')"


def _key(x: str) -> str:
    return rf"regexp_replace({_fold(rf"regexp_replace({x}, '\\[a-zA-Z]+|<[^>]+>', ' ', 'g')")}, '[^a-z0-9]', '', 'g')"


def _without(x: str, part: str) -> str:
    return f"(length({x}) - length(replace({x}, '{part}', '')))"


# Joins and views


@query("""
SELECT c_custkey, r_name AS discipline, n_name AS topic, n_nationkey % 5 <> 0 AS topic_known
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def topic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    known = base.where("n_nationkey % 5 <> 0").select(F.col("r_name").alias("discipline"), F.col("n_name").alias("topic"), F.lit(True).alias("_known"))
    rows = table(spark, sf_dir, "customer").join(base, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("discipline"), F.col("n_name").alias("topic"))
    return rows.join(known, ["discipline", "topic"], "left").select("c_custkey", "discipline", "topic", F.coalesce("_known", F.lit(False)).alias("topic_known"))


@query(f"""
WITH {_N}, r AS (SELECT l_orderkey, number, (p_size % 5 = 0)::INT + (l_quantity > 48)::INT AS errors, (l_quantity < 3)::INT AS warnings
  FROM n JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
m AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS list_id, l_orderkey, number FROM n JOIN orders ON o_orderkey = l_orderkey)
SELECT CAST(c_custkey AS VARCHAR) AS list_id, c_mktsegment AS name, count(r.number) AS questions, count(m.number) - count(r.number) AS dangling,
  count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) FILTER (WHERE warnings > 0) AS with_warnings
FROM customer LEFT JOIN m ON m.list_id = CAST(c_custkey AS VARCHAR) LEFT JOIN r ON r.l_orderkey = m.l_orderkey AND r.number = m.number GROUP BY ALL""")
def bank_list_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every list: the flagship."""
    n = numbered_lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    # Rows and members are read off one numbering: the join below is then on the key it is dealt by.
    rows = n.join(orders.where("o_orderstatus <> 'P'"), "l_orderkey").join(part, "l_partkey")
    rows = rows.select("l_orderkey", "number", ((F.col("p_size") % 5 == 0).cast("int") + (F.col("l_quantity") > 48).cast("int")).alias("errors"), (F.col("l_quantity") < 3).cast("int").alias("warnings"))
    members = n.join(orders, "l_orderkey").select(F.col("o_custkey").cast("string").alias("list_id"), "l_orderkey", "number")
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("list_id"), F.col("c_mktsegment").alias("name"))
    return views.list_summary(lists, members, rows, ["l_orderkey", "number"])


@query(f"""
WITH {_N}, t AS (SELECT l_orderkey, p_type, min(number) AS f FROM n JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_orderkey, string_agg(p_type, '; ' ORDER BY f) AS tags FROM t GROUP BY l_orderkey""")
def list_tags_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.array("p_type").alias("subjects"))
    rows = numbered_lines(spark, sf_dir).join(part, "l_partkey")
    return rows.groupBy("l_orderkey").agg(F.array_join(assemble.ordered_distinct("number", "subjects"), "; ").alias("tags"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_name")
    n = numbered_lines(spark, sf_dir).join(part, "l_partkey")
    return n.select("l_orderkey", "number", F.col("p_brand").alias("institution"), F.year("l_shipdate").alias("year"), F.array("p_type").alias("subjects"), (F.col("p_size") % 5 + 1).alias("difficulty"), F.col("p_name").alias("statement"), "p_size", "l_quantity")


@query(f"""
WITH {_N} SELECT l_orderkey, number, p_brand AS institution, year(l_shipdate) AS year FROM n JOIN part ON l_partkey = p_partkey
WHERE p_brand = 'Brand#12' AND year(l_shipdate) BETWEEN 1995 AND 1996 AND p_size % 5 + 1 = 3""")
def bank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.bank_filter(_questions(spark, sf_dir), years=(1995, 1996), institution="Brand#12", difficulty=3)
    return found.select("l_orderkey", "number", "institution", F.col("year").cast("long").alias("year"))


_SEARCH = r"trim(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)|[$*_#>|\\]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
SELECT doc_id, {_SEARCH} AS search FROM documents WHERE contains({_fold(_SEARCH)}, 'etre')""")
def bank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("statement"))
    return views.bank_filter(rows, text="ÊTRE").select("doc_id", t.search_text(F.col("statement")).alias("search"))


@query(f"""
WITH {_N} SELECT l_orderkey, number FROM n JOIN orders o ON o_orderkey = l_orderkey WHERE l_quantity > 40
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')""")
def readable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).select("l_orderkey", "number", (F.col("l_quantity") > 40).alias("published"))
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("l_orderkey"))
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("list_id"), F.when(F.col("c_mktsegment") == "BUILDING", "publicada").otherwise("rascunho").alias("status"))
    return views.readable(n, members, lists, ["l_orderkey"]).select("l_orderkey", "number")


@query("""
SELECT c_custkey AS list_id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer""")
def correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("list_id"), F.col("c_name").alias("name"))
    return views.list_counts(lists, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id")))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


# The bank


@query(f"""
WITH {_N}, k AS (SELECT * FROM n WHERE l_quantity >= 10)
SELECT l_orderkey AS hash, string_agg(number::VARCHAR, ',' ORDER BY number) AS numbers FROM n
WHERE l_orderkey IN (SELECT l_orderkey FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = n.l_orderkey AND k.number = n.number) GROUP BY l_orderkey""")
def import_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("hash"), "number", "l_quantity")
    lost = bank.dropped_by_import(n, n.where("l_quantity >= 10"))
    return lost.select("hash", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


@query(f"""
WITH {_N}, o AS (SELECT l_orderkey AS hash, number, l_quantity AS value, number % 2 = 0 AS published FROM n JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) < 1996),
w AS (SELECT l_orderkey AS hash, number, CASE WHEN l_quantity > 25 THEN NULL ELSE l_extendedprice END AS value FROM n JOIN orders ON o_orderkey = l_orderkey WHERE month(o_orderdate) <= 6)
SELECT coalesce(o.hash, w.hash) AS hash, coalesce(o.number, w.number) AS number, CASE WHEN w.hash IS NOT NULL THEN w.value ELSE o.value END AS value,
  CASE WHEN o.hash IS NULL THEN false ELSE o.published END AS published, CASE WHEN o.hash IS NULL THEN 'insert' WHEN w.hash IS NULL THEN 'keep' ELSE 'update' END AS op
FROM o FULL JOIN w ON o.hash = w.hash AND o.number = w.number""")
def import_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    n = numbered_lines(spark, sf_dir).join(dates, "l_orderkey")
    old = n.where(F.year("o_orderdate") < 1996).select(F.col("l_orderkey").alias("hash"), "number", F.col("l_quantity").alias("value"), (F.col("number") % 2 == 0).alias("published"))
    new = n.where(F.month("o_orderdate") <= 6).select(F.col("l_orderkey").alias("hash"), "number", F.when(F.col("l_quantity") <= 25, F.col("l_extendedprice")).alias("value"))
    return bank.upsert(old, new, ["hash", "number"], keep=("published",), defaults={"published": F.lit(False)})


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's list asks for questions 1, 3 and again 1 of their orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy("hash"))
    asks = F.inline(F.array(*[F.struct(F.lit(n).alias("number"), (F.col("_r") * 3 + i).cast("int").alias("ord")) for i, n in enumerate((1, 3, 1))]))
    return orders.withColumn("_r", rank).select("list_id", "hash", asks)


_REQUESTS = """q AS (SELECT list_id, hash, unnest([1, 3, 1]) AS number, r * 3 + unnest([0, 1, 2]) AS ord FROM
  (SELECT o_custkey AS list_id, o_orderkey AS hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders))"""


@query(f"""
WITH {_N}, {_REQUESTS}
SELECT list_id, hash, q.number, CAST(min(ord) AS INTEGER) AS position, count(n.number) > 0 AS found
FROM q LEFT JOIN n ON n.l_orderkey = q.hash AND n.number = q.number GROUP BY list_id, hash, q.number""")
def save_list_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("hash"), "number")
    return bank.resolve_members(_requests(spark, sf_dir), questions)


@query(f"""
WITH {_N}, {_REQUESTS}, m AS (SELECT o_custkey AS list_id, l_orderkey AS hash, number, number AS position FROM n JOIN orders ON o_orderkey = l_orderkey)
SELECT m.list_id, m.hash, m.number, m.position FROM m
WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.list_id = m.list_id AND q.hash = m.hash AND q.number = m.number)""")
def membership_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("l_orderkey"))
    members = numbered_lines(spark, sf_dir).join(orders, "l_orderkey").select("list_id", F.col("l_orderkey").alias("hash"), "number", F.col("number").alias("position"))
    return bank.removed_members(members, _requests(spark, sf_dir)).select("list_id", "hash", "number", "position")


@query("""
SELECT o_custkey AS list_id, string_agg(o_orderpriority, ' > ' ORDER BY p) AS origins FROM
  (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS p FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def origins_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderpriority").alias("hash"), F.col("o_orderkey").alias("position"))
    return bank.origins_in_order(members).select("list_id", F.array_join("hashes", " > ").alias("origins"))


@query("""
SELECT user_id, event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A maximum needs no sort of a user's events and is combined before the shuffle.
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("x")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", F.col("x.event_type").alias("state"), "x.event_id")


# Ordered rows


@query("SELECT l_orderkey, string_agg(m::VARCHAR, ',' ORDER BY m) AS missing FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS m FROM lineitem GROUP BY 1) x WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = x.l_orderkey AND l.l_linenumber = x.m) GROUP BY 1")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.missing_numbers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return rows.where(F.size("missing") > 0).select("l_orderkey", F.array_join(F.array_sort("missing").cast("array<string>"), ",").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.repeated_numbers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT c_custkey AS doc, unnest([0, 1, 2, 3]) AS rank, c_custkey % 3 + 3 * unnest([0, 1, 2, 3]) AS start, unnest(['Fixação', 'Treinamento', 'Aprofundamento', 'Desafios']) AS stage FROM customer)
SELECT o_orderkey, month(o_orderdate) AS page, (SELECT arg_max(stage, rank) FROM s WHERE s.doc = o_custkey AND start <= month(o_orderdate)) AS stage FROM orders""")
def stage_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.inline(F.array(*[F.struct(F.lit(k).alias("rank"), (F.col("c_custkey") % 3 + 3 * k).alias("start"), F.lit(s).alias("stage")) for k, s in enumerate(segment.STAGES)]))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), stages)
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"), F.month("o_orderdate").cast("long").alias("page"))
    return assemble.stage_of_page(q, known).drop("doc")


@query("""
SELECT a.event_id, max_by(b.value, b.event_id) AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id""")
def event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("rank"), "value")
    return spatial.last_before(left, right, ["user_id"], "ts", "start", "value", "rank", "last_value").select("event_id", "last_value")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations""")
def carry_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.carry_down(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "header").select("conv_id", "turn", "header")


@query("""
SELECT user_id, y, coalesce(lead(y) OVER (PARTITION BY user_id ORDER BY y), 100000.0) - 2 AS y_end FROM (SELECT DISTINCT user_id, round(value, 2) AS y FROM events)""")
def region_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.round("value", 2).alias("y")).distinct()
    return ordered.region_end(rows, ["user_id"], "y", F.lit(100000.0))


@query("""
SELECT event_id, user_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS group_no FROM (SELECT *,
  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS o FROM events)""")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ordered.gap_groups(rows, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], 21_600_000_000).drop("ts")


@query("""
WITH RECURSIVE a(user_id, anchor, n) AS (SELECT user_id, min(value), 1 FROM events GROUP BY user_id
  UNION ALL SELECT a.user_id, min(e.value), any_value(a.n) + 1 FROM a JOIN events e ON e.user_id = a.user_id AND e.value - a.anchor >= 2.5 GROUP BY a.user_id)
SELECT e.user_id, e.value, e.event_id, max(a.n) AS line_no FROM events e JOIN a ON a.user_id = e.user_id AND a.anchor <= e.value GROUP BY ALL""")
def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    return ordered.anchor_groups(rows, ["user_id"], "value", ["value", "event_id"], 2.5)


@query("""
SELECT conv_id, run_no, role, min(turn) AS first_turn, count(*) AS turns FROM (SELECT *, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run_no FROM
  (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS o FROM conversations)) GROUP BY ALL""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "role", ["turn"])
    return rows.groupBy("conv_id", "run_no", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"))


@query("SELECT conv_id, count(*) AS votes, count(*) FILTER (WHERE length(text) > 120) AS ayes, count(*) FILTER (WHERE length(text) > 120) * 2 > count(*) AS carried FROM conversations GROUP BY conv_id")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.majority(table(spark, sf_dir, "conversations"), ["conv_id"], F.length("text") > 120)


@query("""
SELECT user_id, event_type, votes, best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, length(event_type), best DESC, event_type) AS r FROM
  (SELECT user_id, event_type, count(*) AS votes, max(value) AS best FROM events GROUP BY ALL)) WHERE r = 1""")
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.best_reading(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.length("event_type"), "value")


@query("""
SELECT l_returnflag, min(l_quantity) AS value_at FROM (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS c, floor(0.4 * sum(w) OVER (PARTITION BY l_returnflag)) AS k FROM
  (SELECT l_returnflag, l_quantity, sum(least(12, l_linenumber)) AS w FROM lineitem GROUP BY ALL)) WHERE c > k GROUP BY 1""")
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.least(F.lit(12), "l_linenumber").alias("w"))
    return ordered.weighted_rank_value(rows, ["l_returnflag"], "l_quantity", "w", 0.4)


@query("SELECT source, part, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS INTEGER) AS part FROM documents) GROUP BY ALL")
def batch_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.buckets(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 20)
    return rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


# Places


@query("""
WITH p AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS other, user_id, value AS other_value FROM events WHERE event_type = 'click')
SELECT p.event_id, arg_min(other, struct_pack(d := value - other_value, t := other)) AS nearest_left FROM p LEFT JOIN c ON p.user_id = c.user_id AND value - other_value BETWEEN 0 AND 40 GROUP BY p.event_id""")
def nearest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "value")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("value").alias("other_value"))
    return spatial.nearest_before(left, right, ["user_id"], "value", "other_value", 40, "other", "nearest_left").select("event_id", "nearest_left")


@query(f"""
WITH {_N}, x AS (SELECT l_orderkey, number, epoch(l_shipdate) / 86400 AS lo, epoch(l_shipdate) / 86400 + l_quantity AS hi FROM n),
j AS (SELECT a.l_orderkey, a.number, b.number AS other, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS o FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.number % 2 = 1 AND b.number % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, number ORDER BY o DESC, other) AS k FROM j WHERE o > 0)
SELECT x.l_orderkey, x.number, r.other AS most, r.o AS overlap FROM x LEFT JOIN r ON r.l_orderkey = x.l_orderkey AND r.number = x.number AND k = 1 WHERE x.number % 2 = 1""")
def max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400
    x = numbered_lines(spark, sf_dir).select("l_orderkey", "number", day.alias("lo"), (day + F.col("l_quantity")).alias("hi"))
    right = x.where("number % 2 = 0").select("l_orderkey", F.col("number").alias("other"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    return spatial.most_overlap(x.where("number % 2 = 1"), right, ["l_orderkey"], ["l_orderkey", "number"], "other", "most", side=30)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value AS x0, value + 5 AS x1, CAST(hour(ts) AS DOUBLE) AS y0, hour(ts) + 1.0 AS y1 FROM events)
SELECT event_id FROM e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'view' AND b.user_id = e.user_id AND e.x0 >= b.x0 - 6
  AND e.x1 <= b.x1 + 30 + greatest(8, 0.08 * 35) AND (e.y0 + e.y1) / 2 BETWEEN b.y0 AND b.y1 + 3 + 2)""")
def contained_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.hour("ts").cast("double")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("x0"), (F.col("value") + 5).alias("x1"), h.alias("y0"), (h + 1).alias("y1"))
    boxes = e.where("event_type = 'view'").select("user_id", "x0", (F.col("x1") + 30).alias("x1"), "y0", (F.col("y1") + 3).alias("y1"))
    return spatial.outside_all(e.where("event_type <> 'view'"), boxes, ["user_id"]).select("event_id")


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
z AS (SELECT vec_id, label, list_transform(e, lambda x: x - list_avg(e)) AS c FROM v), u AS (SELECT vec_id, label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM z)
SELECT u.vec_id, round(list_inner_product(u.c, m.c), 4) AS score FROM u JOIN (SELECT label, arg_min(c, vec_id) AS c FROM u GROUP BY label) m USING (label)""")
def grid_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-mean, unit-norm product of each grid with its letter's template."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", numeric.standardised(F.col("embedding")).alias("c"))
    template = rows.groupBy("label").agg(F.min_by("c", "vec_id").alias("t"))
    return rows.join(template, "label").select("vec_id", F.round(numeric.product(F.col("c"), F.col("t")), 4).alias("score"))


# Text


@query(f"""
WITH {_N} SELECT l_orderkey, number, CASE WHEN number % 4 = 0 THEN printf('Questão %02d - %dº Simulado Autoral 2026 - %dº DIA', number, l_orderkey % 20, 1 + number % 2)
  ELSE concat_ws(' - ', 'Lista de Exercícios', p_type, printf('Questão %02d', number), nullif(concat_ws(' ', nullif(CASE WHEN number % 3 = 0 THEN '' ELSE p_brand END, ''), CASE WHEN number % 5 <> 0 THEN year(l_shipdate)::VARCHAR END), '')) END AS title
FROM n JOIN part ON l_partkey = p_partkey""")
def title_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    n = numbered_lines(spark, sf_dir).join(part, "l_partkey")
    i = F.col("number")
    kind = F.when(i % 4 == 0, "simulado").otherwise("lista")
    title = t.title(kind, F.col("p_type"), i, F.when(i % 3 == 0, "").otherwise(F.col("p_brand")), F.when(i % 5 != 0, F.year("l_shipdate")), F.col("l_orderkey") % 20, 1 + i % 2)
    return n.select("l_orderkey", "number", title.alias("title"))


@query(r"""
WITH s AS (SELECT doc_id, concat('Questão ', doc_id % 7, ' ', doc_id % 10, '  UF', upper(lang), ' ', 1990 + doc_id % 9, '/', 2001 + doc_id % 20, ' (Adaptada)') AS bar FROM documents)
SELECT doc_id, CAST(replace(regexp_extract(bar, '^Questão (\d[\d ]*)', 1), ' ', '') AS INTEGER) AS number,
  concat('UF', substr(regexp_extract(bar, 'UF(.*) \(Adaptada', 1), 1, length(regexp_extract(bar, 'UF(.*) \(Adaptada', 1)) - 5)) AS institution, CAST(right(regexp_extract(bar, '(\d{4}) \(Adaptada', 1), 4) AS INTEGER) AS year FROM s""")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    bar = F.concat(F.lit("Questão "), i % 7, F.lit(" "), i % 10, F.lit("  UF"), F.upper("lang"), F.lit(" "), 1990 + i % 9, F.lit("/"), 2001 + i % 20, F.lit(" (Adaptada)"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(bar, F.lit("\n"), "text").alias("s"))
    return d.select("doc_id", t.bar_number(F.col("s")).alias("number"), t.bar_institution(F.col("s")).alias("institution"), t.bar_year(F.col("s")).alias("year"))


_U = "replace(text, '\\$', '')"


@query(rf"""
SELECT doc_id, {_without(_U, "$")} % 2 = 1 AS odd, regexp_matches({_U}, 'R\$\s?\d') AS money,
  CAST(len(list_filter(regexp_extract_all({_U}, '(?s)\$\$.+?\$\$|\$.+?\$'), lambda f: {_without("f", "{")} <> {_without("f", "}")})) AS INTEGER) AS unbalanced FROM documents""")
def latex_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.odd_dollars(x).alias("odd"), t.money_unescaped(x).alias("money"), F.size(t.unbalanced(x)).alias("unbalanced"))


@query(rf"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' ≤ $x ≥ y$ ² ±') ELSE text END AS text FROM documents),
c AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace({_U}, '(?s)\$\$.+?\$\$|\$.+?\$', ' ', 'g'), '')) AS c FROM x)
SELECT doc_id, string_agg(c, ' ' ORDER BY c) AS symbols FROM c WHERE c <> '' AND contains('{t.MATH_SYMBOLS}', c) GROUP BY doc_id""")
def unicode_outside_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" ≤ $x ≥ y$ ² ±"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.symbols_outside(x).alias("s"))
    return rows.where(F.size("s") > 0).select("doc_id", F.array_join("s", " ").alias("symbols"))


_HEADS = r"list_filter(string_split(text, chr(10)), lambda x, i: regexp_matches(x, '^\s*\|') AND (i = 1 OR NOT regexp_matches(string_split(text, chr(10))[i - 1], '^\s*\|')))"


@query(rf"""
SELECT doc_id, array_to_string(list_transform(list_concat(regexp_extract_all(text, '(?s)\*\*(.+?)\*\*', 1), regexp_extract_all(text, '(?s)<strong>(.+?)</strong>', 1), regexp_extract_all(text, '(?s)<thead>(.*?)</thead>', 1), {_HEADS}), lambda x: {_key("x")}), '|') AS keys
FROM documents WHERE contains(text, '**') OR contains(text, '|')""")
def bold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").where(x.contains("**") | x.contains("|")).select("doc_id", t.joined_keys(t.bold_spans(x)).alias("keys"))


@query(rf"SELECT doc_id, CAST(len({_HEADS}) AS INTEGER) AS heads, md5(array_to_string({_HEADS}, chr(10))) AS digest FROM documents WHERE contains(text, '|')")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = t.table_heads(F.concat(F.lit(""), "text"))
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("|"))
    return rows.select("doc_id", F.size(heads).alias("heads"), F.md5(F.array_join(heads, "\n")).alias("digest"))


@query(rf"SELECT page_id, {_key("html")} AS key, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS INTEGER) AS letters FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.key(F.col("html")).alias("key"), F.length(F.regexp_replace("html", "<[^>]+>", "")).alias("letters"))


@query(r"""
WITH p AS (SELECT doc_id, text AS a, substr(text, 1, length(text) // 2) AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(a, '.', ''), '\d+'), lambda n: length(n) >= 2 AND NOT contains(regexp_replace(b, '[^0-9]', '', 'g'), n)))), ',') AS missing FROM p
WHERE regexp_matches(a, '\d')""")
def number_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d"))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(t.numbers_missing(F.col("text"), half))), ",").alias("missing"))


@query(rf"""
WITH p AS (SELECT doc_id, list_distinct(regexp_extract_all({_fold("b.text")}, '[a-zà-ú]{{5,}}')) AS w, {_fold("d.text")} AS d FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)
SELECT doc_id, round(len(list_filter(w, lambda x: contains(d, x))) / len(w), 6) AS coverage FROM p WHERE len(w) > 0""")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    bodies = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("body")).where(F.size(t.long_words(F.col("body"))) > 0)
    return d.join(bodies, "item_id").select("doc_id", F.round(t.word_coverage(F.col("body"), F.col("text")), 6).alias("coverage"))


@query(rf"""
WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10))[2:], lambda x: {_key("x")}) AS k, {_key("concat(text, chr(10), text)")} AS o FROM documents WHERE contains(text, chr(10)))
SELECT doc_id, CAST(len(list_filter(list_distinct(k), lambda x: length(x) >= 12 AND (length(o) - length(replace(o, x, ''))) // length(x) > (length(array_to_string(k, '')) - length(replace(array_to_string(k, ''), x, ''))) // length(x))) AS INTEGER) AS repeated FROM p""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("\n"))
    # Half of the sources have all their lines marked as centred, which the comparison ignores.
    source = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(f"\n{t.CENTRED_MARK}"))).otherwise(F.col("text"))
    return d.select("doc_id", F.size(t.lines_repeated(source, F.concat_ws("\n", "text", "text"))).alias("repeated"))


@query("""
WITH l AS (SELECT conv_id, list(chr((65 + length(text) % 5)::INT) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(x, '') AS letters, len(list_filter(range(2, len(x) + 1), lambda i: x[i] < x[i - 1] AND list_contains(x[2:i], 'B'))) > 0 AS bad FROM l""")
def letter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.chr(65 + F.length("text") % 5)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", letter.alias("c")))), lambda x: x["c"]).alias("x"))
    return rows.select("conv_id", F.array_join("x", "").alias("letters"), t.letters_out_of_order(F.col("x")).alias("bad"))


@query(f"""
WITH {_N} SELECT l_orderkey, string_agg(printf('%02d', number) || '=' || chr((65 + l_partkey % 5)::INT), ' ' ORDER BY number) AS answers FROM n GROUP BY l_orderkey""")
def answer_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir)
    row = F.concat(F.col("number").cast("string"), F.lit("\n "), F.chr(65 + F.col("l_partkey") % 5))
    pages = n.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", row.alias("r")))), lambda x: x["r"]), "\n").alias("page"))
    pairs = F.array_sort(F.map_entries(t.answer_pairs(F.col("page"))))
    return pages.select("l_orderkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("answers"))


@query(f"""
WITH {_N} SELECT l_orderkey, printf('%02d', number) AS "Nº", printf('Questão %02d', number) AS "Título", p_brand AS "Instituição", year(l_shipdate)::VARCHAR AS "Ano", p_type AS "Disciplina", '' AS "Tópico",
  p_size % 5 + 1 AS "Dificuldade", p_name AS "Enunciado", 'a' || p_size AS "Alternativa A", 'b' AS "Alternativa B", CASE WHEN p_size % 2 = 0 THEN 'c' ELSE '' END AS "Alternativa C", '' AS "Alternativa D", '' AS "Alternativa E", 'A' AS "Gabarito", '' AS "Explicação do Professor"
FROM n JOIN part ON l_partkey = p_partkey""")
def fixed_export_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    option = lambda letter, text: F.struct(F.lit(letter).alias("letter"), text.alias("text"))
    options = F.filter(F.array(option("B", F.lit("b")), option("A", F.concat(F.lit("a"), F.col("p_size").cast("string"))), option("C", F.when(F.col("p_size") % 2 == 0, "c"))), lambda o: o["text"].isNotNull())
    q = q.select("l_orderkey", "number", F.concat(F.lit("Questão "), t.two_digits(F.col("number"))).alias("title"), "institution", "year", F.get("subjects", F.lit(0)).alias("discipline"), F.lit("").alias("topic"), "difficulty", "statement", options.alias("options"), F.lit("A").alias("answer"))
    return export.sheet(q.withColumn("title", F.concat_ws("\0", "l_orderkey", "title"))).select(F.split_part("Título", F.lit("\0"), F.lit(1)).cast("long").alias("l_orderkey"), *[F.col(c) if c != "Título" else F.split_part("Título", F.lit("\0"), F.lit(2)).alias(c) for c in export.SHEET])


@query("""
SELECT r_name AS discipline, n_name AS topic, '(''' || replace(r_name, '''', '''''') || ''', ''' || replace(n_name, '''', '''''') || ''', ARRAY[' ||
  CASE WHEN n_nationkey % 2 = 0 THEN '''d''''Or'', ''x''' ELSE '' END || ']::text[])' AS tuple FROM nation JOIN region ON n_regionkey = r_regionkey""")
def seed_sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    subjects = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("d'Or"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return export.topic_tuples(base.select(F.col("r_name").alias("discipline"), F.col("n_name").alias("topic"), subjects.alias("subjects")))


@query("SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 16) || '/Q' || printf('%02d', doc_id % 120) || '_fig1.png' AS path, CAST(ceil(length(text) / 500) AS INTEGER) AS pieces FROM documents WHERE text <> ''")
def content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    hash_ = F.sha2("text", 256)
    name = F.concat(F.lit("Q"), t.two_digits(F.col("doc_id") % 120), F.lit("_fig1"))
    d = table(spark, sf_dir, "documents").where("text <> ''")
    return d.select("doc_id", hash_.alias("hash"), export.figure_path(hash_, name).alias("path"), F.size(export.in_pieces(F.col("text"), 500)).alias("pieces"))


_PARA = r"CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), chr(10), '**Fonte: livro ', doc_id, ' <a>**', chr(10), ' ', chr(10), 'end') ELSE text END"


@query(rf"""
SELECT doc_id, md5(replace(x, concat('**Fonte: livro ', doc_id, ' <a>**'), concat('{t.REFERENCE_OPEN}Fonte: livro ', doc_id, ' &lt;a&gt;{t.REFERENCE_CLOSE}'))) AS digest FROM (SELECT doc_id, {_PARA} AS x FROM documents)""")
def reference_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\n**Fonte: livro "), i, F.lit(" <a>**\n \nend"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("x")).select("doc_id", F.md5(t.format_references(F.col("x"))).alias("digest"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), '') AS b FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN i > 0 AND trim(b) <> '' AND trim(x) <> '' AND starts_with(trim(x), '|') <> starts_with(trim(b), '|') THEN chr(10) || x ELSE x END, chr(10) ORDER BY i)) AS digest FROM p GROUP BY doc_id""")
def tables_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.separate_tables(F.col("text"))).alias("digest"))


@query()
def nfkd_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.key(F.col("text"), exact=True)).alias("digest"))


# Validation and assembly


def _bank_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions made of documents and the customer of their number, documents, topics."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("n_nationkey", (i % 25).cast("int")).join(nation, "n_nationkey")
    letters = F.when(i % 9 == 0, F.array(F.lit("A"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    options = F.transform(letters, lambda x: F.struct(x.alias("letter"), F.when((i % 11 == 0) & (x == "A"), " ").when((i % 13 == 0) & (x == "C"), "(c) text").otherwise("text").alias("text")))
    stage = F.get(F.array(*[F.lit(s) for s in segment.STAGES]), (i % 4).cast("int"))
    questions = d.select(
        F.col("source").alias("doc"), i.cast("int").alias("number"), F.col("r_name").alias("discipline"), F.col("n_name").alias("topic"), F.when(i % 10 == 0, F.array().cast("array<string>")).when(i % 10 == 1, F.array("n_name", F.lit("other"))).otherwise(F.array("n_name")).alias("subjects"),
        stage.alias("stage"), (i % 5 + 1).cast("int").alias("difficulty"), F.col("text").alias("statement"), options.alias("options"), F.when(i % 8 == 0, "E").otherwise("A").alias("answer"), (i % 17 == 0).alias("review"), F.lit(None).cast("string").alias("notes"), F.lit(2000).alias("year"),
    )
    documents = d.select(F.col("source").alias("doc")).distinct().select("doc", F.lit("lista").alias("kind"), F.lit("AFRICA").alias("discipline"), F.lit("ALGERIA").alias("topic"))
    topics = nation.where("n_nationkey % 5 <> 0").select(F.col("r_name").alias("discipline"), F.col("n_name").alias("topic"), F.array().cast("array<string>").alias("subjects"))
    return questions, documents, topics


_CHECKED = ["topic_unknown", "options_order", "answer_not_an_option", "option_empty", "option_starts_with_letter", "difficulty_outside_stage", "no_subject", "subject_unknown", "odd_dollars", "money_unescaped", "review_asked"]


@query(rf"""
WITH d AS (SELECT source AS doc, CAST(doc_id AS INTEGER) AS number, doc_id AS i, doc_id % 4 AS s, doc_id % 5 + 1 AS difficulty, n_nationkey, text FROM documents JOIN nation ON n_nationkey = doc_id % 25),
r AS (SELECT doc, number, unnest([
  CASE WHEN n_nationkey % 5 = 0 THEN 'topic_unknown' END, CASE WHEN i % 9 = 0 THEN 'options_order' END, CASE WHEN i % 8 = 0 THEN 'answer_not_an_option' END, CASE WHEN i % 11 = 0 THEN 'option_empty' END,
  CASE WHEN i % 13 = 0 THEN 'option_starts_with_letter' END, CASE WHEN difficulty NOT BETWEEN s + 1 AND s + 2 THEN 'difficulty_outside_stage' END, CASE WHEN i % 10 = 0 THEN 'no_subject' END, CASE WHEN i % 10 = 1 THEN 'subject_unknown' END,
  CASE WHEN {_without(_U, "$")} % 2 = 1 THEN 'odd_dollars' END, CASE WHEN regexp_matches({_U}, 'R\$\s?\d') THEN 'money_unescaped' END, CASE WHEN i % 17 = 0 THEN 'review_asked' END]) AS rule FROM d)
SELECT doc, number, rule, CASE WHEN rule IN ('option_starts_with_letter', 'difficulty_outside_stage', 'review_asked') THEN 'W' ELSE 'E' END AS severity FROM r WHERE rule IS NOT NULL""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(*_bank_questions(spark, sf_dir), only=_CHECKED).select("doc", "number", "rule", "severity")


@query()
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all rules, per document and rule."""
    found = validate.validate(*_bank_questions(spark, sf_dir))
    return found.groupBy("doc", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_N}, c AS (SELECT l_orderkey, number, chr((65 + p_size % 5)::INT) AS answer, p_brand, p_size, chr((65 + (p_size + (number % 3 = 0)::INT) % 5)::INT) AS official FROM n JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, number, CASE WHEN number < 7 THEN official END AS answer, coalesce(official <> answer AND number < 7, false) AS review, 'UF' || substr(p_brand, 7, 1) AS institution, CAST(1990 + p_size AS INTEGER) AS year, CASE WHEN number >= 7 THEN 'no official answer' END AS problem FROM c""")
def assembled_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_name"), "l_partkey")
    n = n.withColumn("doc", F.col("l_orderkey").cast("string"))
    source = F.concat(F.lit("Questão "), F.col("number").cast("string"), F.lit("  UF"), F.substring("p_brand", 7, 1), F.lit(" "), (1990 + F.col("p_size")).cast("string"), F.lit("\nbody"))
    cut = n.select("doc", "number", F.lit(1).alias("page"), F.lit("").alias("image"), source.alias("source_text"), F.lit("Fixação").alias("stage"), F.array().cast("array<struct<name:string,file:string,centred:boolean,table:boolean>>").alias("figures"), F.array().cast("array<string>").alias("outside"))
    letter = lambda k: F.chr(65 + k % 5)
    no_text = F.lit(None).cast("string")
    transcribed = n.select("doc", "number", no_text.alias("institution"), F.lit(None).cast("int").alias("year"), F.lit("d").alias("discipline"), F.lit("t").alias("topic"), F.array(F.lit("s")).alias("subjects"), F.lit(1).alias("difficulty"), F.col("p_name").alias("statement"), F.array(F.struct(F.lit("A").alias("letter"), F.lit("x").alias("text"))).alias("options"), letter(F.col("p_size")).alias("answer"), F.lit(False).alias("review"), no_text.alias("notes"))
    official = F.map_from_entries(F.collect_list(F.when(F.col("number") < 7, F.struct(t.two_digits(F.col("number")), letter(F.col("p_size") + (F.col("number") % 3 == 0).cast("int"))))))
    documents = n.groupBy("doc").agg(official.alias("answers")).select("doc", F.lit("f.pdf").alias("file"), F.col("doc").alias("hash"), F.lit("lista").alias("kind"), F.lit("T").alias("title"), "answers")
    return assemble.assemble(cut, transcribed, documents).select(F.col("doc").cast("long").alias("l_orderkey"), "number", "answer", "review", "institution", "year", "problem")
