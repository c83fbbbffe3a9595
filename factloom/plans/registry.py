"""Every registered query of the fact-analysis operators over the driver tables, and its SQL oracle.

The driver tables stand in for program facts, whole and by their own keys: consecutive suppliers of an order are edges, orders
point to customers, regions hold nations. A shared SQL text defines these facts for both sides; the operators themselves are DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import facts, graph, lattice, layout, pointsto
from factloom.operators.fixpoint import settle

TABLES = "region nation customer supplier part orders lineitem events".split()


#: Bytes of compressed tables for each partition of a shuffle: rows grow to ten times that, or more, where they are sorted.
DEALT = 4_000_000
#: The most bytes of a shuffle, and of files, that adaptive execution and scans put together for one task: without these it is 64 and 128 MB of compressed rows.
TOGETHER = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16_000_000, "spark.sql.files.maxPartitionBytes": 32_000_000}
#: How many times its file a table of facts counts when Spark decides what the driver gathers to broadcast: files of 8 MB have held rows of 570.
PACKED = 32


def deal(spark: SparkSession, paths: list[str]) -> None:
    """Let sizes of files count by PACKED; raise the number of shuffle partitions with the size of the tables, so that a task's rows do not grow with them; small shuffles are put together again by adaptive execution, up to TOGETHER."""
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        return
    for name, most in TOGETHER.items():
        if not spark.conf._jconf.contains(name):  # whoever sets it is right
            spark.conf.set(name, f"{most}b")
    if not spark.conf._jconf.contains("spark.sql.sources.fileCompressionFactor"):
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(PACKED))
    size, hadoop = 0, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(hadoop).getContentSummary(where).getLength()
    if size // DEALT > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // DEALT))


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL in which the driver tables are named plainly."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    deal(spark, [f"{sf_dir}/{t}.parquet" for t in used])
    for t in used:
        text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
    return spark.sql(text, **used)


def edges_sql(more: str = "") -> str:
    """Neighbouring, different suppliers of an order's lines, over all of lineitem; `more` narrows the lines."""
    return f"""SELECT DISTINCT a AS src, b AS dst FROM (
  SELECT l_suppkey AS a, LEAD(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS b,
         l_linenumber AS n, l_returnflag AS f, l_quantity AS q FROM lineitem) t
WHERE b IS NOT NULL AND a <> b{more}"""


E = edges_sql()
#: Holders of each thing, an acyclic graph of four levels: region, nation, customer, order, each with ids of its own.
HELD = """SELECT 1000000 + CAST(n_regionkey AS BIGINT) AS src, 2000000 + CAST(n_nationkey AS BIGINT) AS dst FROM nation
UNION ALL SELECT 2000000 + CAST(c_nationkey AS BIGINT), 3000000 + c_custkey FROM customer UNION ALL SELECT 3000000 + o_custkey, 1000000000 + o_orderkey FROM orders"""
CLOSURE = "tc(src, dst) AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON e.src = tc.dst)"
VERTS = "vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e)"
SCC = "s AS (SELECT v, least(v, coalesce((SELECT min(x.dst) FROM tc x JOIN tc y ON x.src = y.dst AND x.dst = y.src WHERE x.src = v), v)) AS component FROM vs)"
COND = "c AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN s a ON a.v = e.src JOIN s b ON b.v = e.dst WHERE a.component <> b.component)"
ENTRY = "SELECT min(src) AS v FROM e"
DOM = f"""{CLOSURE}, en AS ({ENTRY}), live AS (SELECT v FROM en UNION SELECT dst FROM tc JOIN en ON src = v),
r(d, v) AS (SELECT live.v, en.v FROM live, en WHERE live.v <> en.v UNION SELECT r.d, e.dst FROM r JOIN e ON e.src = r.v WHERE e.dst <> r.d),
dom AS (SELECT d, v FROM (SELECT a.v AS d, b.v AS v FROM live a, live b) p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.d = p.d AND r.v = p.v))"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def with_e(edges: str, rest: str) -> str:
    return f"WITH RECURSIVE e AS ({edges}), {rest}"


@query("transitive_closure", with_e(E, f"{CLOSURE} SELECT src, dst FROM tc"))
def _closure(spark, sf):
    return graph.transitive_closure(sql(spark, sf, E))


@query("reachable_from", with_e(E, "r(v) AS (SELECT min(src) FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.v) SELECT v FROM r"))
def _reachable(spark, sf):
    e = settle(sql(spark, sf, E))  # read more than once
    return graph.reachable(e, e.agg(F.min("src").alias("v")))


@query("edge_inverse", f"WITH e AS ({E}) SELECT dst AS src, src AS dst FROM e")
def _inverse(spark, sf):
    return graph.inverse(sql(spark, sf, E))


@query("symmetric_closure", f"WITH e AS ({E}) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def _symmetric(spark, sf):
    return graph.symmetric_closure(sql(spark, sf, E))


@query("scc_label", with_e(E, f"{CLOSURE}, {VERTS}, {SCC} SELECT v, component FROM s"))
def _scc(spark, sf):
    return graph.scc(sql(spark, sf, E))


@query("condensation", with_e(E, f"{CLOSURE}, {VERTS}, {SCC}, {COND} SELECT src, dst FROM c"))
def _condensation(spark, sf):
    return graph.condensation(sql(spark, sf, E))


@query("connected_components", with_e(E, f"{VERTS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(v, w) AS (SELECT v, v FROM vs UNION SELECT r.v, b.dst FROM r JOIN b ON b.src = r.w) SELECT v, min(w) AS component FROM r GROUP BY v"))
def _components(spark, sf):
    return graph.components(sql(spark, sf, E))


@query("topo_level", with_e(E, f"{CLOSURE}, {VERTS}, {SCC}, {COND}, l(v, level) AS (SELECT DISTINCT component, 0 FROM s UNION SELECT c.src, l.level + 1 FROM l JOIN c ON c.dst = l.v) SELECT v, max(level) AS level FROM l GROUP BY v"))
def _levels(spark, sf):
    e = settle(sql(spark, sf, E))  # read more than once
    labels = graph.scc(e)
    return graph.levels(graph.condensation(e, labels), labels.select(F.col("component").alias("v")).distinct())


@query("simple_paths", with_e(HELD, f"{VERTS}, p(src, dst, path, n) AS (SELECT v, v, [v], 0 FROM vs UNION ALL SELECT p.src, e.dst, list_append(p.path, e.dst), n + 1 FROM p JOIN e ON e.src = p.dst WHERE NOT list_contains(p.path, e.dst)) SELECT src, dst, array_to_string(path, '>') AS path, n FROM p WHERE n > 0"))
def _paths(spark, sf):
    e = sql(spark, sf, HELD)
    return graph.simple_paths(e, graph.vertices(e))


@query("dominators", with_e(E, f"{DOM} SELECT d, v FROM dom"))
def _dominators(spark, sf):
    e = settle(sql(spark, sf, E))  # read more than once
    return graph.dominators(e, e.agg(F.min("src").alias("v")))


@query("back_edges", with_e(E, f"{DOM} SELECT e.src, e.dst FROM e JOIN dom ON dom.d = e.dst AND dom.v = e.src"))
def _back(spark, sf):
    e = settle(sql(spark, sf, E))  # read more than once
    return graph.back_edges(e, e.agg(F.min("src").alias("v"))).select("src", "dst")


@query("join_points", f"WITH e AS ({E}) SELECT dst AS v, count(DISTINCT src) AS n_preds FROM e GROUP BY dst HAVING count(DISTINCT src) > 1")
def _joins(spark, sf):
    return graph.join_points(sql(spark, sf, E))


#: Slots over whole tables: suppliers from 10 million on, nations from 20, parts from 30, customers (four slots each) from 40 million,
#: orders from 1 billion, what is read through an order from 2 billion.
CONSTRAINTS = {
    "addr": "SELECT 1000000000 + o_orderkey AS l, 40000000 + 4 * o_custkey AS o FROM orders UNION SELECT 10000000 + s_suppkey, 20000000 + CAST(s_nationkey AS BIGINT) FROM supplier",
    "cp": "SELECT DISTINCT 1000000000 + l_orderkey AS r, 30000000 + l_partkey AS l FROM lineitem",
    "gep": "SELECT DISTINCT 1000000000 + l_orderkey AS r, 30000000 + l_partkey AS l, CAST(l_linenumber AS BIGINT) AS w FROM lineitem WHERE l_returnflag = 'R'",
    "st": "SELECT DISTINCT 1000000000 + l_orderkey AS v, CAST(l_linenumber AS BIGINT) AS proj, 10000000 + l_suppkey AS r FROM lineitem",
    "ld": "SELECT DISTINCT 2000000000 + l_orderkey AS l, 1000000000 + l_orderkey AS v, CAST(l_linenumber AS BIGINT) AS proj FROM lineitem WHERE l_linestatus = 'O'",
    "ends": "SELECT 40000000 + 4 * c_custkey + j AS i, 40000000 + 4 * c_custkey + CASE WHEN j = 0 THEN 3 ELSE j END AS e FROM customer, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x UNION ALL SELECT 20000000 + CAST(n_nationkey AS BIGINT), 20000000 + CAST(n_nationkey AS BIGINT) FROM nation",
}
PTS = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in CONSTRAINTS.items()) + """,
f(k, x, y, one) USING KEY (k, x, y) AS (
  SELECT 'p', l, o, 1 FROM addr UNION ALL SELECT 'c', r, l, 1 FROM cp
  UNION
  SELECT n.k, n.x, n.y, 1 FROM (
    SELECT 'p' k, c.y x, p.y y FROM recurring.f c JOIN recurring.f p ON c.k = 'c' AND p.k = 'p' AND c.x = p.x
    UNION SELECT 'p', g.l, p.y + g.w FROM gep g JOIN recurring.f p ON p.k = 'p' AND p.x = g.r JOIN ends e ON e.i = p.y AND p.y + g.w <= e.e
    UNION SELECT 'c', p.y + ld.proj, ld.l FROM ld JOIN recurring.f p ON p.k = 'p' AND p.x = ld.v JOIN ends e ON e.i = p.y AND p.y + ld.proj <= e.e
    UNION SELECT 'c', st.r, p.y + st.proj FROM st JOIN recurring.f p ON p.k = 'p' AND p.x = st.v JOIN ends e ON e.i = p.y AND p.y + st.proj <= e.e) n
  WHERE EXISTS (SELECT 1 FROM f) AND NOT EXISTS (SELECT 1 FROM recurring.f o WHERE o.k = n.k AND o.x = n.x AND o.y = n.y)),
pts AS (SELECT x AS loc, y AS obj FROM f WHERE k = 'p')"""
TAKEN = "taken AS (SELECT DISTINCT unnest(range(obj, e + 1)) AS slot FROM pts JOIN ends ON i = obj)"
WRITES = "SELECT DISTINCT l_suppkey AS fn, CASE WHEN l_returnflag = 'R' THEN 1000000000 + l_orderkey ELSE 40000000 + 4 * l_suppkey END AS loc, l_returnflag = 'R' AS deref, CAST(l_linenumber AS BIGINT) - 1 AS proj, 1 + CAST(l_linenumber AS BIGINT) AS len FROM lineitem"
#: Regions call their nations, nations their suppliers.
CALLS = "SELECT 2000000 + CAST(n_regionkey AS BIGINT) AS src, 1000000 + CAST(n_nationkey AS BIGINT) AS dst FROM nation UNION ALL SELECT 1000000 + CAST(s_nationkey AS BIGINT), s_suppkey FROM supplier"
WSETS = f"""wr AS ({WRITES}), ws AS (
  SELECT DISTINCT fn, slot FROM (
    SELECT fn, unnest(range(loc + proj, loc + proj + len)) AS slot FROM wr WHERE NOT deref
    UNION ALL SELECT fn, slot FROM (SELECT fn, e, unnest(range(obj + proj, obj + proj + len)) AS slot FROM wr JOIN pts ON pts.loc = wr.loc JOIN ends ON i = obj WHERE deref) x WHERE slot <= e) y
  WHERE slot IN (SELECT slot FROM taken))"""


def _constraints(spark, sf):
    return {k: sql(spark, sf, v) for k, v in CONSTRAINTS.items()}


def _pts(spark, sf):
    c = _constraints(spark, sf)
    return pointsto.points_to(c["addr"], c["cp"], c["gep"], c["st"], c["ld"], c["ends"]), c["ends"]


@query("points_to", f"{PTS} SELECT loc, obj FROM pts")
def _points_to(spark, sf):
    return _pts(spark, sf)[0]


@query("address_taken", f"{PTS}, {TAKEN} SELECT slot FROM taken")
def _taken(spark, sf):
    return pointsto.address_taken(*_pts(spark, sf))


def _write_sets(spark, sf):
    pts, ends = _pts(spark, sf)
    return pointsto.write_sets(sql(spark, sf, WRITES), pts, ends, pointsto.address_taken(pts, ends))


@query("write_sets", f"{PTS}, {TAKEN}, {WSETS} SELECT fn, slot FROM ws")
def _writes(spark, sf):
    return _write_sets(spark, sf)


@query("call_writes", f"{PTS}, {TAKEN}, {WSETS}, e AS ({CALLS}), {CLOSURE}, fs AS (SELECT DISTINCT src AS fn, dst AS g FROM tc UNION SELECT fn, fn FROM ws) SELECT DISTINCT fs.fn, ws.slot FROM fs JOIN ws ON ws.fn = fs.g")
def _call_writes(spark, sf):
    return pointsto.call_writes(_write_sets(spark, sf), sql(spark, sf, CALLS))


SITES = "SELECT DISTINCT l_suppkey AS fn, l_orderkey AS block, 30000000 + l_partkey AS slot FROM lineitem"
ENTRIES = "SELECT c_custkey AS callee, 40000000 + 4 * c_custkey AS obj FROM customer WHERE c_acctbal < 0"


@query("indirect_calls", f"{PTS} SELECT DISTINCT s.fn, s.block, x.callee FROM ({SITES}) s JOIN pts ON pts.loc = s.slot JOIN ({ENTRIES}) x ON x.obj = pts.obj")
def _indirect(spark, sf):
    pts, _ = _pts(spark, sf)
    return pointsto.resolve_indirect(sql(spark, sf, SITES), pts, sql(spark, sf, ENTRIES))


OPS = """SELECT o_custkey AS fn, CASE o_orderstatus WHEN 'F' THEN 'deref' WHEN 'P' THEN 'union' ELSE 'call' END AS kind, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS callee, CAST(NULL AS BIGINT) AS union_id FROM orders
UNION ALL SELECT 10000000 + CAST(c_nationkey AS BIGINT), 'call', c_custkey, CAST(NULL AS BIGINT) FROM customer"""
FNS = "SELECT c_custkey AS fn FROM customer UNION ALL SELECT 10000000 + CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 20000000 + o_orderkey FROM orders"


@query("unsafety_report", f"""WITH RECURSIVE ops AS ({OPS}), fns AS ({FNS}), e AS (SELECT DISTINCT fn AS src, callee AS dst FROM ops WHERE kind = 'call' AND callee IN (SELECT fn FROM fns)),
{CLOSURE}, k AS (SELECT fn, kind FROM ops WHERE kind <> 'call' OR callee NOT IN (SELECT fn FROM fns)), r AS (SELECT src AS fn, dst FROM tc UNION SELECT fn, fn FROM fns),
u AS (SELECT r.fn, bool_or(kind = 'union') AS un FROM r JOIN k ON k.fn = r.dst GROUP BY r.fn)
SELECT count(*) AS total, count(u.fn) AS n_unsafe, count(*) FILTER (WHERE un) AS n_union, (count(*) FILTER (WHERE un))::DOUBLE / nullif(count(u.fn), 0) AS ratio FROM fns LEFT JOIN u ON u.fn = fns.fn""")
def _unsafety(spark, sf):
    fns = sql(spark, sf, FNS)
    kinds, calls = facts.split_calls(sql(spark, sf, OPS), fns)
    return facts.unsafety(fns, kinds, calls)


SOLVENT, DIRECT = "SELECT s_suppkey AS fn FROM supplier WHERE s_acctbal > 0", "SELECT s_suppkey AS fn FROM supplier WHERE s_acctbal > 9000"


@query("alloc_wrappers", f"""WITH RECURSIVE c AS ({E}), cand AS ({SOLVENT}),
a(fn) AS (SELECT fn FROM ({DIRECT}) d UNION SELECT c.src FROM a JOIN c ON c.dst = a.fn WHERE c.src IN (SELECT fn FROM cand)) SELECT fn FROM a""")
def _alloc(spark, sf):
    return facts.allocators(sql(spark, sf, SOLVENT), sql(spark, sf, DIRECT), sql(spark, sf, E))


@query("foreign_types", f"""WITH RECURSIVE c AS ({HELD}), r(t) AS (SELECT DISTINCT src FROM c WHERE src = 1000003 UNION SELECT c.dst FROM r JOIN c ON c.src = r.t),
m AS (SELECT src AS t FROM c UNION SELECT dst FROM c) SELECT t AS type, t IN (SELECT t FROM r) AS is_foreign FROM m""")
def _foreign(spark, sf):
    refs = sql(spark, sf, HELD)
    return facts.partition_types(refs, refs.filter("src = 1000003").select(F.col("src").alias("v")).distinct())


FIELDS = "SELECT l_orderkey AS ty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS field, 1 + l_partkey % 4 AS len FROM lineitem"


@query("layout_offsets", f"SELECT ty, field, len, CAST(coalesce(sum(len) OVER (PARTITION BY ty ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({FIELDS}) t")
def _layout(spark, sf):
    return facts.layout(sql(spark, sf, FIELDS).withColumn("field", F.col("field").cast("long")))


@query("union_offset_ranges", f"SELECT ty, field, len, CAST(\"offset\" AS BIGINT) AS \"offset\", CAST(coalesce(lead(\"offset\") OVER (PARTITION BY ty ORDER BY field), total) AS BIGINT) AS until FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY ty ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\", sum(len) OVER (PARTITION BY ty) AS total FROM ({FIELDS}) f) t")
def _ranges(spark, sf):
    return facts.field_ranges(facts.layout(sql(spark, sf, FIELDS).withColumn("field", F.col("field").cast("long"))))


@query("absint_join", "SELECT l_suppkey AS k, CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') END AS vals, CASE WHEN count(DISTINCT l_partkey) <= 10 THEN array_to_string(list_sort(list(DISTINCT l_partkey)), ',') END AS parts FROM lineitem GROUP BY 1")
def _absint(spark, sf):
    rows = sql(spark, sf, "SELECT * FROM lineitem")
    text = lambda c: F.concat_ws(",", c.cast("array<string>"))
    sets = lambda column, name: lattice.bounded_sets(rows.select(F.col("l_suppkey").alias("k"), F.col(column).alias(name)), ["k"], name)
    out = sets("l_linenumber", "a").join(sets("l_partkey", "b"), "k")
    return out.select("k", F.when(F.col("a").isNotNull(), text(F.col("a"))).alias("vals"), F.when(F.col("b").isNotNull(), text(F.col("b"))).alias("parts"))


@query("absint_widen", """WITH s AS (SELECT o_custkey AS k, list_sort(list(DISTINCT extract(month FROM o_orderdate)) FILTER (WHERE o_orderstatus = 'F')) AS a, list_sort(list(DISTINCT extract(month FROM o_orderdate))) AS b FROM orders GROUP BY 1)
SELECT k, CASE WHEN a IS NULL THEN array_to_string(b, ',') WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN array_to_string(a, ',') END AS vals FROM s""")
def _widen(spark, sf):
    month = F.month("o_orderdate")
    s = sql(spark, sf, "SELECT * FROM orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", month))).alias("a"), F.array_sort(F.collect_set(month)).alias("b"))
    out = facts.widen(F.col("a"), F.col("b"))
    return s.select("k", F.when(out.isNotNull(), F.concat_ws(",", out.cast("array<string>"))).alias("vals"))


USES = "SELECT DISTINCT l_suppkey AS owner, CAST(l_linenumber AS BIGINT) AS field, l_returnflag AS variant, l_partkey AS tag FROM lineitem"


@query("fd_tag_discovery", f"""WITH u AS ({USES}), bad AS (SELECT DISTINCT owner, field FROM (SELECT owner, field, tag FROM u GROUP BY ALL HAVING count(DISTINCT variant) > 1) x),
n AS (SELECT owner, field, count(DISTINCT variant) AS n_variants FROM u WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.owner = u.owner AND bad.field = u.field) GROUP BY 1, 2 HAVING count(DISTINCT variant) > 1)
SELECT owner, field, n_variants FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n_variants DESC, field) AS r FROM n) y WHERE r = 1""")
def _tags(spark, sf):
    return facts.discover_tags(sql(spark, sf, USES))


SPANS = "SELECT o_custkey AS key, o_orderkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 1 + CAST(floor(o_totalprice) AS BIGINT) % 200 AS hi, o_orderstatus AS s FROM orders"


@query("interval_overlap_join", f"WITH t AS ({SPANS}) SELECT a.key, a.id AS l_id, b.id AS r_id FROM t a JOIN t b ON a.key = b.key AND a.s = 'F' AND b.s = 'O' AND a.lo < b.hi AND b.lo < a.hi")
def _overlap(spark, sf):
    t = sql(spark, sf, SPANS)
    return facts.overlaps(t.filter("s = 'F'"), t.filter("s = 'O'"))


#: A customer's done orders are accesses, its open orders their branches: what is known where the access is and where the branch begins are the nations of the
#: suppliers of their lines; before the branch lies the order of the number before, of which something is known if it has lines.
NATIONS = "SELECT DISTINCT l_orderkey AS place, CAST(l_linenumber AS BIGINT) AS path, CAST(s_nationkey AS BIGINT) AS tagset FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"
ASKED = f"""SELECT DISTINCT a.o_orderkey AS access, b.o_orderkey AS branch, n.tagset, a.o_orderkey AS here, b.o_orderkey AS entry, b.o_orderkey - 1 AS before FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'
JOIN ({NATIONS}) n ON n.place = a.o_orderkey"""


@query("branch_tag_filter", f"""WITH n AS ({NATIONS}), q AS ({ASKED}) SELECT q.access, q.branch, q.tagset, h.path FROM q JOIN n h ON h.place = q.here AND h.tagset = q.tagset
WHERE EXISTS (SELECT 1 FROM n WHERE n.place = q.entry AND n.path = h.path AND n.tagset = q.tagset) AND EXISTS (SELECT 1 FROM n WHERE n.place = q.before)
AND NOT EXISTS (SELECT 1 FROM n WHERE n.place = q.before AND n.path = h.path AND n.tagset = q.tagset)""")
def _branches(spark, sf):
    tags = sql(spark, sf, NATIONS).withColumn("field", F.lit(0))
    paths = tags.select(F.col("place").alias("access"), "path").distinct()
    return facts.tagged_by_branch(sql(spark, sf, ASKED).withColumn("field", F.lit(0)), paths, tags, tags.select("place")).select("access", "branch", "tagset", "path")


ARMS = "SELECT l_suppkey AS key, l_partkey AS id, l_partkey AS lo, l_partkey + 3 AS hi, l_orderkey AS ord, l_returnflag AS flag FROM lineitem WHERE l_linestatus = 'F'"
READS = "SELECT l_suppkey AS key, l_orderkey AS id, min(l_partkey) AS lo, min(l_partkey) + 2 AS hi, max(l_returnflag) AS flag FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2"


@query("arm_access", f"""WITH a AS ({READS}), m AS (SELECT key, min(id) AS id, lo, hi, min(ord) AS ord, min(flag) AS flag FROM ({ARMS}) x GROUP BY key, lo, hi),
j AS (SELECT a.key, a.id AS access, m.id AS arm, a.flag AS f, m.flag AS g, row_number() OVER (PARTITION BY a.key, a.id ORDER BY m.ord, m.id) AS r FROM a JOIN m ON a.key = m.key AND a.lo < m.hi AND m.lo < a.hi)
SELECT key, access, arm FROM j WHERE r = 1 AND (f = g OR g = 'N')""")
def _arms(spark, sf):
    arms = sql(spark, sf, ARMS).groupBy("key", "lo", "hi").agg(F.min("id").alias("id"), F.min("ord").alias("ord"), F.min("flag").alias("flag"))
    reads = sql(spark, sf, READS).withColumn("tags", F.array("flag"))
    return facts.arm_accesses(reads, arms.withColumn("tags", F.when(F.col("flag") != "N", F.array("flag"))))


@query("merged_weights", f"""WITH e AS ({E}), n AS (SELECT s_suppkey AS v, s_nationkey AS c FROM supplier) SELECT DISTINCT CAST(a.c AS BIGINT) AS src, CAST(b.c AS BIGINT) AS dst, CAST(a.v - b.v AS BIGINT) AS weight FROM e JOIN n a ON a.v = e.src JOIN n b ON b.v = e.dst""")
def _weights(spark, sf):
    labels = sql(spark, sf, "SELECT s_suppkey AS v, CAST(s_nationkey AS BIGINT) AS component FROM supplier")
    return graph.merge_weighted(sql(spark, sf, E).withColumn("weight", F.col("src") - F.col("dst")), labels)


#: Orders as functions whose locals are their lines, parts as types of 1 to 50 slots by size.
LOCALS = "SELECT l_orderkey AS fn, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) - 1 AS local, l_partkey AS ty FROM lineitem"
TYPES = "SELECT p_partkey AS ty, CAST(p_size AS BIGINT) AS len FROM part"


@query("slot_numbers", f"""WITH l AS ({LOCALS}), t AS ({TYPES}), x AS (SELECT l.*, t.len, n_args, CASE WHEN local = 0 THEN n_args WHEN local <= n_args THEN local - 1 ELSE local END AS place
FROM l JOIN t ON t.ty = l.ty JOIN (SELECT fn, CAST(floor((count(*) - 1) / 2) AS INT) AS n_args FROM l GROUP BY fn) f ON f.fn = l.fn)
SELECT fn, local, CAST(coalesce(sum(len) OVER (ORDER BY fn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS root FROM x""")
def _slots(spark, sf):
    rows = sql(spark, sf, LOCALS)
    fns = rows.groupBy("fn").agg(F.floor((F.count(F.lit(1)) - 1) / 2).cast("int").alias("n_args")).withColumn("item", F.col("fn"))
    return layout.slots(fns, rows, sql(spark, sf, TYPES)).select("fn", "local", F.col("root").cast("long").alias("root"))


@query("taken_results", """WITH RECURSIVE c AS (SELECT o_custkey AS fn, CAST(extract(month FROM o_orderdate) AS INT) - 1 AS dst, CAST(extract(day FROM o_orderdate) AS INT) AS src, o_orderkey, o_orderstatus FROM orders),
t AS (SELECT DISTINCT fn, dst FROM c WHERE o_orderstatus = 'P'), k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.fn = c.fn AND t.dst = c.dst)),
r(fn, local) AS (SELECT DISTINCT fn, 0 FROM k UNION SELECT r.fn, k.src FROM r JOIN k ON k.fn = r.fn AND k.dst = r.local AND k.o_orderstatus = 'F')
SELECT DISTINCT r.fn, k.o_orderkey AS callee FROM r JOIN k ON k.fn = r.fn AND k.dst = r.local AND k.o_orderstatus = 'O'""")
def _returned(spark, sf):
    steps = sql(spark, sf, "SELECT o_custkey AS fn, CAST(month(o_orderdate) AS INT) - 1 AS dst, CAST(day(o_orderdate) AS INT) AS src, o_orderkey AS callee, o_orderstatus AS s FROM orders")
    taken = steps.filter("s = 'P'").select("fn", F.col("dst").alias("local")).distinct()
    return facts.returned_calls(steps.filter("s = 'F'").select("fn", "dst", "src"), taken, steps.filter("s = 'O'").select("fn", "dst", "callee"))


ASSIGNS = "SELECT user_id AS key, event_id AS pos, event_type AS target FROM events"


@query("assign_islands", f"""WITH t AS ({ASSIGNS}), m AS (SELECT *, CASE WHEN lag(target) OVER (PARTITION BY key ORDER BY pos) = target THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT key, target, min(pos) AS first, count(*) AS n FROM r GROUP BY key, target, run HAVING count(*) > 1""")
def _islands(spark, sf):
    return facts.islands(sql(spark, sf, ASSIGNS))


@query("candidate_filter", """SELECT l_suppkey AS ty, CAST(l_linenumber AS BIGINT) AS field, l_orderkey AS union FROM lineitem l WHERE l_linestatus = 'F' AND l_returnflag = 'R'
AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
AND (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 0) OR EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = l.l_suppkey AND x.l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_linenumber = x.l_linenumber AND y.l_tax > 0.07)))""")
def _candidates(spark, sf):
    fields = sql(spark, sf, """SELECT l_suppkey AS ty, CAST(l_linenumber AS BIGINT) AS field, CASE WHEN l_returnflag = 'R' THEN 'C2RustUnnamed_0' ELSE 'named' END AS type_name, CASE l_linestatus WHEN 'F' THEN 'union' ELSE 'int' END AS kind, l_orderkey AS type FROM lineitem""")
    changed = sql(spark, sf, "SELECT DISTINCT l_suppkey AS ty, CAST(l_linenumber AS BIGINT) AS field FROM lineitem WHERE l_tax > 0.07")
    structs = sql(spark, sf, "SELECT s_suppkey AS ty, s_acctbal, s_nationkey FROM supplier")
    only = fields.select(F.col("type").alias("union")).distinct().join(sql(spark, sf, "SELECT o_orderkey AS union FROM orders WHERE o_orderstatus = 'P'"), "union", "left_anti")
    return facts.candidates(structs.select("ty"), fields, structs.filter("s_acctbal < 0").select("ty"), changed, structs.filter("s_nationkey = 0").select("ty", F.lit(99).alias("field")), only)


@query("wrap_arith", "SELECT o_orderkey, ((o_orderkey * 37 + 128) % 256 + 256) % 256 - 128 AS i8, ((o_orderkey * 104729 + 32768) % 65536 + 65536) % 65536 - 32768 AS i16 FROM orders")
def _wrap(spark, sf):
    key = F.col("o_orderkey")
    return sql(spark, sf, "SELECT o_orderkey FROM orders").select("o_orderkey", facts.wrap(key * 37, 8).alias("i8"), facts.wrap(key * 104729, 16).alias("i16"))


@query("normalize_text", r"SELECT p_partkey, regexp_replace('(' || p_name || ' )', '[\s()]', '', 'g') AS norm FROM part")
def _normalize(spark, sf):
    return sql(spark, sf, "SELECT * FROM part").select("p_partkey", facts.normalize(F.concat(F.lit("("), "p_name", F.lit(" )"))).alias("norm"))


@query("codegen_listagg", "SELECT p_brand AS key, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS pattern, count(DISTINCT p_size) = 1 AS single FROM part GROUP BY p_brand")
def _listagg(spark, sf):
    out = facts.patterns(sql(spark, sf, "SELECT p_brand AS key, p_type AS tag, p_size AS variant FROM part"))
    return out.select("key", "pattern", F.col("variant").isNotNull().alias("single"))


@query("statistics_sum", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
def _statistics(spark, sf):
    return facts.statistics(sql(spark, sf, "SELECT l_returnflag, l_linenumber AS lines, 1 AS n, l_suppkey AS keys FROM lineitem"), ["l_returnflag"])


@query("apply_edits", "SELECT CAST(c_custkey AS VARCHAR) AS path, '<' || substr(c_name, 3, 3) || '[' || c_mktsegment || ']' || substr(c_name, 9) AS content FROM customer")
def _edits(spark, sf):
    c = sql(spark, sf, "SELECT * FROM customer").withColumn("path", F.col("c_custkey").cast("string"))
    edits = c.select("path", F.lit(0).alias("lo"), F.lit(2).alias("hi"), F.lit("<").alias("text")).union(c.select("path", F.lit(5), F.lit(8), F.concat(F.lit("["), "c_mktsegment", F.lit("]"))))
    return facts.apply_edits(c.select("path", F.col("c_name").alias("content")), edits)
