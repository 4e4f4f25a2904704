"""Filters, joins, roll-ups and orders over the sales tables: the relational patterns that the domain tables have no data for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import merge, order, rollup
from lexloom.plans.relational import query as _query
from lexloom.runtime import Scratch, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Priorities of orders from the least to the greatest.
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
_RANK = "list_position(['" + "', '".join(PRIORITIES) + "'], {})"


def query(sql: str):
    return _query(sql, QUERIES, SQL)


class NotFound(LookupError):
    """No row has the key that was asked for."""


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key; NotFound if there is none."""
    found = df.where(F.col(key) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise NotFound(f"{key} = {value}")
    return found


@query("SELECT id, slug, title FROM contracts WHERE slug = (SELECT min(slug) FROM contracts)")
def contract_by_slug(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup by a unique key."""
    c = read(spark, d, "contracts").select("id", "slug", "title")
    return lookup(c, "slug", c.agg(F.min("slug")).first()[0])


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_type LIKE '%ARD' AND p_name LIKE '%widget' GROUP BY 1")
def standard_widgets(spark: SparkSession, d: str) -> DataFrame:
    """Suffix predicates."""
    return read(spark, d, "part").where(F.endswith("p_type", F.lit("ARD")) & F.endswith("p_name", F.lit("widget"))).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_shipdate <> TIMESTAMP '1995-06-17' GROUP BY 1")
def lines_unlike(spark: SparkSession, d: str) -> DataFrame:
    """Inequality filters."""
    return read(spark, d, "lineitem").where("l_returnflag <> 'N' and l_shipdate <> timestamp '1995-06-17 00:00:00'").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE '5-LOW' END AS priority, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status, starts_with(o_orderpriority, '1-') AS urgent FROM orders")
def normalised_orders(spark: SparkSession, d: str) -> DataFrame:
    """Values outside of a vocabulary become a default or null; a flag by prefix."""
    return read(spark, d, "orders").select("o_orderkey", rollup.within(F.col("o_orderpriority"), PRIORITIES[2:], "5-LOW").alias("priority"), rollup.within(F.col("o_orderstatus"), ("F", "O")).alias("status"), F.startswith("o_orderpriority", F.lit("1-")).alias("urgent"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered_at, CASE WHEN c_custkey IS NOT NULL THEN to_json({'id': c_custkey, 'name': c_name}) END AS customer
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def order_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Renamed fields, ISO times, and a nested object that is null where there is nothing to nest."""
    c = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("customer"))
    o = read(spark, d, "orders").join(c, "o_custkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ordered_at"), F.to_json("customer").alias("customer"))


@query("SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def line_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of four left joins; what isn't found stays null to the end."""
    t = lambda x: read(spark, d, x)
    c = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")
    j = t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    j = j.join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region").select("r_regionkey", "r_name"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, o.k AS last_order, o.p AS last_price FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def last_orders(spark: SparkSession, d: str) -> DataFrame:
    """A left join after the other side was brought down to one row a key."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("o"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("o.o_orderkey").alias("last_order"), F.col("o.o_totalprice").alias("last_price"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def line_names(spark: SparkSession, d: str) -> DataFrame:
    """Left joins to two dimensions."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, "l_partkey", "left").join(s, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


def new_days(days: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    """Days (column ``day``) to take in: those not seen yet, or all when forced."""
    return days.distinct() if force else days.distinct().join(seen, "day", "left_anti")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL)")
def unseen_days(spark: SparkSession, d: str) -> DataFrame:
    """Days with orders on which nothing was shipped."""
    return new_days(read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@query("""SELECT o_orderkey, coalesce(first_part, -1) AS first_part, coalesce(n, 0) AS n, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned
FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey""")
def first_returns(spark: SparkSession, d: str) -> DataFrame:
    """Answers put onto what was asked: of several for a key the first counts, a missing one gets defaults, one nobody asked for is dropped."""
    answers = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.count("*").alias("n"))
    return read(spark, d, "orders").select("o_orderkey").join(answers, "o_orderkey", "left").select("o_orderkey", F.coalesce("first_part", F.lit(-1)).alias("first_part"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("returned"))


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def told_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """A fan-out join: every open order to all suppliers of the customer's nation."""
    o = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    return o.join(c, "c_custkey").join(read(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey").select("o_orderkey", "s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')))")
def orders_of_region(spark: SparkSession, d: str) -> DataFrame:
    """A chain of semi joins."""
    r = read(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    n = read(spark, d, "nation").join(r, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    c = read(spark, d, "customer").join(n, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT c_custkey, s_suppkey FROM c JOIN s ON s.i = c.i % n OR s.i = (c.i + 1) % n WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey)")
def dealt_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt to two suppliers in turn, but for pairs that know each other already."""
    with_place = lambda t, k: order.positions(read(spark, d, t).select(k), k, scratch=Scratch(spark, "dealt"))
    known = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey"))
    return order.dealt_out(with_place("customer", "c_custkey"), with_place("supplier", "s_suppkey"), 2).select("c_custkey", "s_suppkey").join(known, ["c_custkey", "s_suppkey"], "left_anti")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders")
def order_positions(spark: SparkSession, d: str) -> DataFrame:
    """The place of every order by date, the newest first, without sorting them all in one task."""
    o = read(spark, d, "orders").select("o_orderkey", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("_new"))
    return order.positions(o, "_new", "o_orderkey").select("o_orderkey", "position")


@query("SELECT s.i AS seat, c_custkey AS id, c_name AS name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) s UNION ALL SELECT i, s_suppkey, s_name FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) WHERE i >= (SELECT count(*) FROM customer)")
def seats(spark: SparkSession, d: str) -> DataFrame:
    """An upsert by place: suppliers hold seats in order, customers take them over in order."""
    seated = lambda t, k, n: order.positions(read(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name")), "id", name="seat", scratch=Scratch(spark, "seats"))
    return merge.upsert(seated("supplier", "s_suppkey", "s_name"), seated("customer", "c_custkey", "c_name"), "seat").select("seat", "id", "name")


@query("SELECT i AS place, r_regionkey FROM (SELECT unnest(['EUROPE', 'ATLANTIS', 'ASIA']) AS r_name, generate_subscripts(['EUROPE', 'ATLANTIS', 'ASIA'], 1) - 1 AS i) JOIN region USING (r_name)")
def named_regions(spark: SparkSession, d: str) -> DataFrame:
    """Those of a list of names that exist, with their places in the list."""
    names = spark.range(1).select(F.posexplode(F.array(F.lit("EUROPE"), F.lit("ATLANTIS"), F.lit("ASIA"))).alias("place", "r_name"))
    return read(spark, d, "region").join(F.broadcast(names), "r_name").select("place", "r_regionkey")


_LEVELS = f"SELECT c_nationkey, c_custkey, o_orderkey, {_RANK.format('o_orderpriority')} AS rank, n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query(f"SELECT c_custkey, ['{chr(39).join(PRIORITIES).replace(chr(39), chr(39) + ', ' + chr(39))}'][max(rank)] AS priority, count(*) AS orders, sum(coalesce(n, 0)) AS lines FROM ({_LEVELS}) GROUP BY 1")
def customer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Greatest priority and sums from lines to orders to customers."""
    return _rolled(spark, d, "c_custkey")


@query(f"SELECT c_nationkey, ['{chr(39).join(PRIORITIES).replace(chr(39), chr(39) + ', ' + chr(39))}'][max(rank)] AS priority, count(*) AS orders, sum(coalesce(n, 0)) AS lines FROM ({_LEVELS}) GROUP BY 1")
def nation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One level more, from what the level below gives."""
    c = _rolled(spark, d, "c_custkey", "c_nationkey")
    return c.groupBy("c_nationkey").agg(rollup.greatest_of(F.col("priority"), PRIORITIES, "5-LOW").alias("priority"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"))


def _rolled(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = read(spark, d, "orders").join(lines, "o_orderkey", "left").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return o.groupBy(*keys).agg(rollup.greatest_of(F.col("o_orderpriority"), PRIORITIES, "5-LOW").alias("priority"), F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'O') THEN 'open' WHEN bool_and(l_linestatus = 'F') THEN 'filled' ELSE 'partly' END AS state FROM lineitem GROUP BY 1")
def order_states(spark: SparkSession, d: str) -> DataFrame:
    """A state that holds for all rows of a key, or a mixed one."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(rollup.settled_state(F.col("l_linestatus"), "O", "F", "open", "filled", "partly").alias("state"))


@query("SELECT p_type AS type, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def orders_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders per kind of part, the most frequent first; ties by name."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"))
    return read(spark, d, "lineitem").join(p, "l_partkey").groupBy("type").agg(F.countDistinct("l_orderkey").alias("orders")).orderBy(F.desc("orders"), "type")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def returned_of_filled(spark: SparkSession, d: str) -> DataFrame:
    """A count behind a filter and a semi join."""
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").where("l_returnflag = 'R'").join(o, "l_orderkey", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    """A log in order, its head; ties by id."""
    return read(spark, d, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("""SELECT o_orderkey, coalesce(v, o_orderpriority) AS priority FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(CASE l_returnflag WHEN 'R' THEN '1-URGENT' WHEN 'A' THEN '2-HIGH' END, (l_linenumber, l_returnflag = 'A')) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) ON l_orderkey = o_orderkey""")
def raised_orders(spark: SparkSession, d: str) -> DataFrame:
    """A conditional update: the first valid override of each key is taken over, other rows stay."""
    flag = F.when(F.col("l_returnflag") == "R", "1-URGENT").when(F.col("l_returnflag") == "A", "2-HIGH").otherwise(F.col("l_returnflag"))
    overrides = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", flag.alias("priority"))
    first = merge.first_valid(overrides, "o_orderkey", "priority", ("l_linenumber", "priority"), PRIORITIES)
    return merge.update_where_given(read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")), first, "o_orderkey", "priority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def waiting_orders(spark: SparkSession, d: str) -> DataFrame:
    """A queue that is made anew each time from what isn't done: failures stay in it."""
    return read(spark, d, "orders").join(read(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%-d %b %Y') AS day, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS clock FROM events")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    """Days and times as they read in a place."""
    ts = F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", T.local_day(ts).alias("day"), T.local_clock(ts).alias("clock"))


_HIT = "(SELECT id, text, strpos(lower(text), 'rent') AS pos FROM clauses WHERE text IS NOT NULL)"


@query(f"SELECT id, CASE WHEN pos = 0 THEN text ELSE substr(text, 1, pos - 1) END AS before, CASE WHEN pos > 0 THEN substr(text, pos, 4) END AS hit, CASE WHEN pos > 0 THEN substr(text, pos + 4) END AS after FROM {_HIT}")
def highlighted(spark: SparkSession, d: str) -> DataFrame:
    """Texts parted at the first place where a word stands, whatever its case."""
    h = T.highlight(F.col("text"), F.lit("rent"))
    return read(spark, d, "clauses").where("text is not null").select("id", h["before"].alias("before"), h["hit"].alias("hit"), h["after"].alias("after"))


@query("SELECT id, '`' || ref || '` was updated' || CASE WHEN document_id IS NOT NULL THEN ' for contract ' || document_id ELSE '' END AS message FROM clauses WHERE ref IS NOT NULL")
def update_messages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "clauses").where("ref is not null").select("id", T.update_message(F.col("ref"), F.concat(F.lit("contract "), F.col("document_id").cast("string"))).alias("message"))


_MONTHS = r"'(?i)\b(?:one|two|1|2)\s*(?:\(\s*[12]\s*\)\s*)?(?:calendar\s+)?months?"
_DAYS = r"'(?i)\b(?:thirty|sixty|30|60)\s*(?:\(\s*(?:30|60)\s*\)\s*)?days"
_THREE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, " + _MONTHS + r"''s?', 'three (3) months''', 'g'), " + _MONTHS + r"', 'three (3) months', 'g'), " + _DAYS + r"''', 'three (3) months''', 'g'), " + _DAYS + r"', 'three (3) months', 'g')"


@query(f"SELECT id, {_THREE} <> text AS changed, CASE WHEN {_THREE} <> text THEN {_THREE} ELSE rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)) || ' " + T.FALLBACK.strip() + r"' END AS rewritten, regexp_matches(text, '(?i)(?:\(\s*[\d_]+\s*\)|\b\d+)\s*(?:calendar\s+)?(?:months?|days?|weeks?)\b') AS has_period FROM clauses WHERE text IS NOT NULL")
def rewritten_periods(spark: SparkSession, d: str) -> DataFrame:
    r = T.rewrite_periods(F.col("text"))
    return read(spark, d, "clauses").where("text is not null").select("id", r["changed"].alias("changed"), r["text"].alias("rewritten"), T.has_period(F.col("text")).alias("has_period"))


@query("SELECT DISTINCT part FROM (SELECT l_partkey AS part FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT p_partkey FROM part WHERE p_size = 50)")
def either_part(spark: SparkSession, d: str) -> DataFrame:
    """A union as a set."""
    return read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("part")).union(read(spark, d, "part").where("p_size = 50").select("p_partkey")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def dearest_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each customer."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, d, "orders").withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")
