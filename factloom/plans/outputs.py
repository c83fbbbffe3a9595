"""Registered queries of what comes before and after the analysis: seeds from fact rows, counters of a pass, the dump of a solution; each SQL text defines the facts for both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import seeds
from factloom.operators.fixpoint import scratch, settle
from factloom.sources import dump

from .registry import query, sql

#: A part is a slot that points to the orders that take it.
POINTERS = "SELECT l_partkey AS loc, l_orderkey AS obj FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL"


@query("solution_dump", f"""WITH p AS ({POINTERS}), s AS (SELECT unnest(range(0, (SELECT max(loc) + 1 FROM p))) AS loc)
SELECT s.loc, d.obj FROM s LEFT JOIN (SELECT DISTINCT loc, obj FROM p) d ON d.loc = s.loc""")
def _dump(spark, sf):
    """The sets of all slots up to the largest, written as a dump and read again."""
    pts = sql(spark, sf, POINTERS)
    slots = pts.agg(F.coalesce(F.max("loc") + 1, F.lit(1))).first()[0]
    path = scratch(spark)
    dump.write_dump(pts, slots, path)
    return dump.read_dump(spark, path)


RETURNING = "SELECT s_suppkey AS fn FROM supplier WHERE s_acctbal > 0"


@query("observed_lines", """SELECT 'lines' AS name, CAST(count(*) FILTER (WHERE l_quantity > 10) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE l_quantity <= 10 OR l_quantity IS NULL) AS BIGINT) AS rejected,
  CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_quantity > 10), 0) AS BIGINT) AS numbers, count(*) FILTER (WHERE l_quantity > 10 AND l_returnflag = 'R') AS returned,
  count(*) FILTER (WHERE l_quantity > 10 AND l_linestatus = 'O') AS open, CAST(coalesce(sum(l_suppkey) FILTER (WHERE l_quantity > 10), 0) AS BIGINT) AS suppliers,
  (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity > 10) AS parts FROM lineitem""")
def _observed(spark, sf):
    """Counters of all lines, taken in the pass that writes the accepted ones, which the last figure is then of."""
    lines = sql(spark, sf, "SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem")
    counters = {"numbers": F.col("l_linenumber"), "returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "suppliers": F.col("l_suppkey")}
    out, seen = seeds.observed(lines, counters, F.col("l_quantity") > 10)
    kept, n = settle(out.select("l_partkey")), seen.get
    return kept.agg(F.count_distinct("l_partkey").alias("parts")).select(
        F.lit("lines").alias("name"), F.lit(n["rows"]).cast("long").alias("accepted"), F.lit(n["rejected"]).cast("long").alias("rejected"),
        *[F.lit(n[c]).cast("long").alias(c) for c in counters], "parts",
    )


#: What mentions a type: a line's order mentions its part. Urgent orders are foreign items, high ones structs, those of medium priority unions; the others are functions. Types are parts and, as owners, orders' customers.
MENTIONS = """SELECT o_custkey AS owner, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CASE WHEN o_orderstatus = 'P' THEN 'foreign' ELSE 'fn' END WHEN '2' THEN 'struct' WHEN '3' THEN 'union' ELSE 'fn' END AS owner_kind,
  l_suppkey AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@query("foreign_mentions", f"""WITH RECURSIVE m AS ({MENTIONS}), e AS (SELECT DISTINCT owner AS src, type AS dst FROM m WHERE owner_kind IN ('struct', 'union')),
r(t) AS (SELECT DISTINCT type FROM m WHERE owner_kind = 'foreign' UNION SELECT e.dst FROM r JOIN e ON e.src = r.t)
SELECT t AS type, t IN (SELECT t FROM r) AS is_foreign FROM (SELECT type AS t FROM m UNION SELECT src FROM e) x WHERE t IS NOT NULL""")
def _mentions(spark, sf):
    return seeds.foreign_types(sql(spark, sf, MENTIONS))


#: Suppliers are functions; each line is a call by its supplier. Lines that came back call an allocator if their quantity is small, others the supplier of the next line of the order.
#: The result goes to the local of the line's number. Open lines copy it to local 0; the others take the address of their local.
CALLS = """SELECT l_suppkey AS fn, CAST(l_linenumber AS BIGINT) AS local, l_returnflag = 'R' AS foreign_, CASE WHEN l_quantity < 3 THEN 'libc::malloc' ELSE 'free' END AS name, l_linestatus = 'O' AS copied, l_discount < 0.01 AS addressed,
  lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS callee FROM lineitem"""


@query("wrapper_functions", f"""WITH RECURSIVE c AS MATERIALIZED ({CALLS}), cand AS ({RETURNING}),
taken AS (SELECT DISTINCT fn, local FROM c WHERE addressed), flows AS (SELECT DISTINCT fn, local FROM c WHERE copied AND (fn, 0) NOT IN (SELECT fn, local FROM taken)),
res AS (SELECT DISTINCT c.fn, foreign_, name, callee FROM c JOIN flows ON flows.fn = c.fn AND flows.local = c.local WHERE (c.fn, c.local) NOT IN (SELECT fn, local FROM taken) AND c.fn IN (SELECT fn FROM cand)),
a(fn) AS (SELECT DISTINCT fn FROM res WHERE foreign_ AND name = 'libc::malloc' UNION SELECT res.fn FROM a JOIN res ON res.callee = a.fn AND NOT res.foreign_) SELECT fn FROM a""")
def _wrappers(spark, sf):
    rows = settle(sql(spark, sf, CALLS).withColumn("id", F.monotonically_increasing_id()))
    none = F.array().cast("array<struct<kind:string,field:int>>")
    statement = lambda df, first, dst, rvalue: df.select((F.col("id") * 2 + first).alias("id"), "fn", dst.alias("local"), none.alias("path"), F.lit(rvalue).alias("rvalue"))
    copies, refs = rows.filter("copied"), rows.filter("addressed")
    stmts = statement(copies, 0, F.lit(0).cast("long"), "use").union(statement(refs, 1, F.lit(-1).cast("long"), "ref"))
    operand = lambda df, first: df.select((F.col("id") * 2 + first).alias("id"), F.lit(0).alias("pos"), F.lit("place").alias("kind"), "local", none.alias("path"))
    operands = operand(copies, 0).union(operand(refs, 1))
    calls = rows.select("fn", F.when(F.col("foreign_"), "extern").otherwise("direct").alias("kind"), F.when(~F.col("foreign_"), F.col("callee")).alias("callee"), "name", F.col("local").alias("dst"))
    return seeds.wrapper_functions(sql(spark, sf, RETURNING), stmts, operands, calls)
