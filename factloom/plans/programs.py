"""More registered queries: constraints of statements and calls, layout, states, tags and text, over the whole driver tables.

The SQL texts in capitals define the facts for both sides; importing this module adds its queries to those of the registry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import constraints, facts, graph, lattice, layout, pointsto
from factloom.operators.fixpoint import settle

from .registry import DOM, E, HELD, query, sql, with_e

#: Orders are statements, and their lines the operands.
STMTS = """SELECT o_orderkey AS id, 40000000 + 8 * o_custkey AS root, CAST(0 AS BIGINT) AS proj, o_totalprice < 100000 AS deref,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'use' WHEN '2-HIGH' THEN 'ref' WHEN '3-MEDIUM' THEN 'binary' WHEN '4-NOT SPECIFIED' THEN 'aggregate_adt' ELSE 'repeat' END AS rvalue,
  CASE o_orderstatus WHEN 'F' THEN 'Eq' ELSE 'Add' END AS op, CAST(2 AS BIGINT) AS len, CAST(1 AS BIGINT) AS elem_len FROM orders"""
PARTS = """SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) - 1 AS pos,
  CASE l_returnflag WHEN 'R' THEN 'static' WHEN 'A' THEN 'place' ELSE CASE WHEN l_tax > 0.06 THEN 'int' ELSE 'place' END END AS kind,
  80000000 + 8 * l_partkey AS root, CAST(l_linenumber AS BIGINT) AS proj, l_linestatus = 'F' AND l_returnflag <> 'R' AS deref, CAST(l_linenumber AS BIGINT) - 1 AS field_at, CAST(1 AS BIGINT) AS len FROM lineitem"""
ASSIGNED = f"""ss AS ({STMTS}), os AS ({PARTS}),
asg AS (SELECT ss.root AS l_root, CASE WHEN rvalue = 'aggregate_adt' THEN ss.proj + field_at ELSE ss.proj END AS l_proj, ss.deref AS l_deref, os.root AS r_root, os.proj AS r_proj,
  os.deref AND kind = 'place' AS r_deref, rvalue = 'ref' OR kind = 'static' AS r_ref, CASE rvalue WHEN 'repeat' THEN elem_len WHEN 'aggregate_adt' THEN os.len ELSE ss.len END AS len
  FROM ss JOIN os ON ss.id = os.id WHERE kind <> 'int' AND (rvalue = 'aggregate_adt' OR (rvalue IN ('use', 'ref', 'repeat') AND pos = 0) OR (rvalue = 'binary' AND op <> 'Eq' AND NOT (os.deref AND pos = 0))))"""


def _assigned(spark, sf):
    return constraints.assignments(sql(spark, sf, STMTS), sql(spark, sf, PARTS).withColumnRenamed("field_at", "offset"))


@query("statement_assignments", f"WITH {ASSIGNED} SELECT * FROM asg")
def _statements(spark, sf):
    return _assigned(spark, sf)


@query("constraint_generation", f"""WITH {ASSIGNED}, k AS (SELECT *, unnest(range(len)) AS i FROM asg), s AS (SELECT l_root, l_root + l_proj + i AS l, l_proj + i AS lp, r_root, r_root + r_proj + i AS r, r_proj + i AS rp, l_deref, r_ref, r_deref FROM k)
SELECT 'addr' AS kind, l AS a, r AS b, 0 AS w FROM s WHERE NOT l_deref AND r_ref AND NOT r_deref UNION SELECT 'copy', r, l, 0 FROM s WHERE NOT l_deref AND NOT r_ref AND NOT r_deref
UNION SELECT CASE WHEN rp = 0 THEN 'copy' ELSE 'gep' END, r_root, l, rp FROM s WHERE NOT l_deref AND r_ref AND r_deref UNION SELECT 'store', l_root, r, lp FROM s WHERE l_deref AND NOT r_ref AND NOT r_deref
UNION SELECT 'load', l, r_root, rp FROM s WHERE NOT l_deref AND NOT r_ref AND r_deref UNION SELECT 'invalid', l_root, r_root, count(*) FROM asg WHERE l_deref AND (r_ref OR r_deref) GROUP BY l_root, r_root""")
def _generation(spark, sf):
    made = constraints.constraints(_assigned(spark, sf))
    columns = {"addr": ("l", "o", None), "copy": ("r", "l", None), "gep": ("r", "l", "w"), "store": ("v", "r", "proj"), "load": ("l", "v", "proj")}
    out = made["invalid"].groupBy(F.lit("invalid").alias("kind"), F.col("l_root").alias("a"), F.col("r_root").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    for kind, (a, b, w) in columns.items():
        out = out.union(made[kind].select(F.lit(kind), a, b, F.col(w) if w else F.lit(0).cast("long")))
    return out


#: Orders are calls, and their lines the arguments.
CALLED = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'direct' WHEN 'O' THEN CASE WHEN o_totalprice < 200000 THEN 'indirect' ELSE 'extern' END ELSE 'std' END AS kind,
  CASE WHEN o_orderpriority < '3' THEN 'option::unwrap' ELSE 'mem::swap' END AS name, 50000000 + 8 * o_custkey AS callee, 2000000000 + 8 * o_orderkey AS dst, CAST(2 AS BIGINT) AS dst_len, o_orderpriority < '4' AS dst_is_ptr, 4000000000 + 8 * o_orderkey AS alloc FROM orders"""
CALL_ARGS = PARTS.replace(", CAST(l_linenumber AS BIGINT) - 1 AS field_at, CAST(1 AS BIGINT) AS len", ", 1 + CAST(l_linenumber AS BIGINT) AS len")


@query("call_assignments", f"""WITH cs AS ({CALLED}), os AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM ({CALL_ARGS}) x),
n AS (SELECT id, CAST(sum(len) AS BIGINT) AS place FROM os GROUP BY id), g AS (SELECT cs.*, os.root, os.proj, os.deref, os.len, os.place, os.pos, os.kind AS arg FROM cs JOIN os ON cs.id = os.id WHERE os.kind <> 'int')
SELECT callee AS l_root, place AS l_proj, kind = 'indirect' AS l_deref, root AS r_root, proj AS r_proj, deref AND arg = 'place' AS r_deref, arg = 'static' AS r_ref, len FROM g WHERE kind IN ('direct', 'indirect')
UNION ALL SELECT dst, 0, FALSE, root, proj, deref AND arg = 'place', arg = 'static', dst_len FROM g WHERE kind = 'std' AND name = 'option::unwrap' AND pos = 0
UNION ALL SELECT dst, 0, FALSE, callee, coalesce(n.place, 0), kind = 'indirect', FALSE, dst_len FROM cs LEFT JOIN n ON n.id = cs.id WHERE kind IN ('direct', 'indirect')
UNION ALL SELECT dst, 0, FALSE, alloc, 0, FALSE, TRUE, dst_len FROM cs WHERE kind = 'extern' AND dst_is_ptr""")
def _calls(spark, sf):
    return constraints.call_assignments(sql(spark, sf, CALLED), sql(spark, sf, CALL_ARGS))


#: What holds something is a struct of it, an order is one slot, and a supplier is an array of the customer of its number.
FIELDS = f"SELECT src AS ty, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INT) - 1 AS field, CASE WHEN dst >= 1000000000 AND dst % 3 = 0 THEN NULL ELSE dst END AS child FROM ({HELD}) h"
SHAPES = """SELECT 1000000 + CAST(r_regionkey AS BIGINT) AS ty, 'struct' AS kind, CAST(NULL AS BIGINT) AS elem FROM region UNION ALL SELECT 2000000 + CAST(n_nationkey AS BIGINT), 'struct', NULL FROM nation
UNION ALL SELECT 3000000 + c_custkey, 'struct', NULL FROM customer UNION ALL SELECT 1000000000 + o_orderkey, 'primitive', NULL FROM orders UNION ALL SELECT 500000000 + s_suppkey, 'array', 3000000 + c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey"""
LENS = f"""fs AS ({FIELDS}), sh AS ({SHAPES}), l0 AS (SELECT ty, 1 AS len FROM sh WHERE kind = 'primitive'), l1 AS (SELECT ty, greatest(count(fs.field), 1) AS len FROM sh LEFT JOIN fs USING (ty) WHERE ty BETWEEN 3000000 AND 499999999 GROUP BY ty),
l2 AS (SELECT sh.ty, greatest(coalesce(sum(len), 0), 1) AS len FROM sh LEFT JOIN fs ON fs.ty = sh.ty LEFT JOIN l1 ON l1.ty = fs.child WHERE sh.ty BETWEEN 2000000 AND 2999999 GROUP BY sh.ty),
l3 AS (SELECT sh.ty, greatest(coalesce(sum(len), 0), 1) AS len FROM sh LEFT JOIN fs ON fs.ty = sh.ty LEFT JOIN l2 ON l2.ty = fs.child WHERE sh.ty BETWEEN 1000000 AND 1999999 GROUP BY sh.ty),
ls AS (SELECT ty, CAST(len AS BIGINT) AS len FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT sh.ty, len FROM sh JOIN l1 ON l1.ty = elem) x)"""
OFFSETS = 'fo AS (SELECT fs.ty, field, child, CAST(coalesce(sum(coalesce(len, 1)) OVER (PARTITION BY fs.ty ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM fs LEFT JOIN ls ON ls.ty = child)'


@query("type_lengths", f"WITH {LENS} SELECT ty, len FROM ls")
def _lengths(spark, sf):
    return layout.lengths(sql(spark, sf, SHAPES), sql(spark, sf, FIELDS))


def _placed(spark, sf):
    shapes, fields = sql(spark, sf, SHAPES), sql(spark, sf, FIELDS)
    lens = layout.lengths(shapes, fields)
    return shapes, lens, layout.offsets(fields, lens)


@query("field_offsets", f"WITH {LENS}, {OFFSETS} SELECT * FROM fo")
def _offsets(spark, sf):
    return _placed(spark, sf)[2]


@query("object_ends", f"""WITH RECURSIVE {LENS}, {OFFSETS}, inn AS (SELECT ty, child, "offset" FROM fo WHERE child IS NOT NULL UNION ALL SELECT ty, elem, 0 FROM sh WHERE kind = 'array'),
ob(ty, cur, i) AS (SELECT ty, ty, CAST(0 AS BIGINT) FROM sh UNION SELECT ob.ty, inn.child, ob.i + inn."offset" FROM ob JOIN inn ON inn.ty = ob.cur)
SELECT ty, i, max(e) AS e FROM (SELECT ob.ty, i, i + len - 1 AS e FROM ob JOIN ls ON ls.ty = ob.cur UNION ALL SELECT ob.ty, i + fo."offset", i + fo."offset" FROM ob JOIN fo ON fo.ty = ob.cur AND fo.child IS NULL) x GROUP BY ty, i""")
def _ends(spark, sf):
    shapes, lens, placed = _placed(spark, sf)
    return layout.type_ends(shapes, placed, lens)


#: A customer's orders are bit fields of one byte array; those half done have a setter of another name.
ACCESSED = "SELECT o_custkey AS ty, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) - 1 AS pair, o_orderkey, o_orderstatus FROM orders"


@query("bit_fields", f"SELECT ty, 'b' || o_orderkey AS name, pair + 2 AS field, 'int' AS type FROM ({ACCESSED}) a JOIN customer ON c_custkey = ty AND c_acctbal > 0 WHERE o_orderstatus <> 'P'")
def _bits(spark, sf):
    rows = sql(spark, sf, ACCESSED).withColumn("name", F.concat(F.lit("b"), "o_orderkey"))
    setter = F.concat(F.when(F.col("o_orderstatus") == "P", "put_").otherwise("set_"), "name")
    accessors = rows.select("ty", (F.col("pair") * 2).alias("pos"), setter.alias("name"), F.lit(None).cast("string").alias("returns")).union(rows.select("ty", F.col("pair") * 2 + 1, "name", F.lit("int")))
    names = rows.filter("o_orderstatus <> 'P'").groupBy("ty").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pair", "name")))["name"], "_").alias("name"))
    held = names.join(sql(spark, sf, "SELECT c_custkey AS ty, c_acctbal FROM customer"), "ty")
    fields = held.select("ty", F.lit(1).alias("field"), F.when(F.col("c_acctbal") > 0, F.col("name")).otherwise("c2rust_padding0").alias("name"), F.lit(True).alias("is_bytes"))
    return layout.bitfields(fields.union(held.select("ty", F.lit(0), F.lit("n"), F.lit(False))), accessors)


@query("allocation_slots", """WITH s AS (SELECT o_custkey AS item, o_orderkey AS block, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT max(n_regionkey) + 1 AS len FROM nation), b AS (SELECT max(4 * c_custkey) + 4 AS base FROM customer), r AS (SELECT item AS fn, block, CAST(base + n * len AS BIGINT) AS root, len FROM s, w, b)
SELECT root + j AS i, root + CASE WHEN j = 0 THEN len - 1 ELSE j END AS e FROM (SELECT root, len, unnest(range(len)) AS j FROM r) x""")
def _allocations(spark, sf):
    sites = sql(spark, sf, "SELECT o_custkey AS item, o_custkey AS fn, o_orderkey AS block FROM orders WHERE o_orderstatus = 'F'")
    held = sql(spark, sf, "SELECT CAST(n_nationkey AS BIGINT) AS ty, CAST(n_regionkey AS BIGINT) AS last FROM nation")
    ends = held.select("ty", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"), "last").select("ty", "i", F.when(F.col("i") == 0, F.col("last")).otherwise(F.col("i")).alias("e"))
    return layout.allocation_slots(sites, sql(spark, sf, "SELECT 4 * c_custkey AS root, CAST(4 AS BIGINT) AS len FROM customer"), ends, held.select("ty"))[1]


@query("loop_bodies", with_e(E, f"{DOM}, back AS (SELECT e.src, e.dst FROM e JOIN dom ON dom.d = e.dst AND dom.v = e.src), lb(head, v) AS (SELECT head, v FROM (SELECT dst AS head, src AS v FROM back UNION SELECT dst, dst FROM back) x UNION SELECT lb.head, e.src FROM lb JOIN e ON e.dst = lb.v WHERE lb.v <> lb.head) SELECT head, v FROM lb"))
def _loops(spark, sf):
    e = settle(sql(spark, sf, E))  # read more than once
    return graph.loop_bodies(e, e.agg(F.min("src").alias("v")))


#: Lines of rich suppliers are read, those of indebted ones set anew.
READ = "SELECT DISTINCT l_suppkey AS block, l_linenumber AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 9000"
SET = "SELECT DISTINCT l_suppkey AS block, l_linenumber AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0"


@query("live_names", with_e(E, f"u AS ({READ}), d AS ({SET}), li(block, name) AS (SELECT block, name FROM u UNION SELECT e.src, li.name FROM li JOIN e ON e.dst = li.block WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.block = e.src AND d.name = li.name)) SELECT DISTINCT e.src AS block, li.name FROM li JOIN e ON e.dst = li.block"))
def _live(spark, sf):
    return graph.live_out(sql(spark, sf, E), sql(spark, sf, READ), sql(spark, sf, SET))


@query("joined_states", """WITH g AS (SELECT o_custkey AS state, o_orderpriority AS local, o_orderstatus AS s, list(DISTINCT CAST(extract(month FROM o_orderdate) AS INT)) AS v FROM orders GROUP BY 1, 2, 3)
SELECT a.state, a.local, CASE WHEN len(list_distinct(a.v || b.v)) <= 10 THEN array_to_string(list_sort(list_distinct(a.v || b.v)), ',') END AS vals FROM g a JOIN g b ON a.state = b.state AND a.local = b.local AND a.s = 'F' AND b.s = 'O'""")
def _joined(spark, sf):
    rows = sql(spark, sf, "SELECT o_custkey AS state, o_orderpriority AS local, o_orderstatus AS s, month(o_orderdate) AS v FROM orders")
    side = lambda s: lattice.bounded_sets(rows.filter(F.col("s") == s), ["state", "local"], "v").withColumnRenamed("v", "vals")
    out = facts.join_states(side("F"), side("O"))
    return out.select("state", "local", F.when(F.col("vals").isNotNull(), F.concat_ws(",", F.col("vals").cast("array<string>"))).alias("vals"))


@query("alias_names", "SELECT o_custkey AS state, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS a, o_orderkey AS b FROM orders")
def _aliases(spark, sf):
    return facts.aliases(sql(spark, sf, "SELECT o_custkey AS state, o_orderkey AS local, o_orderpriority AS target FROM orders"))


COMPARED = """SELECT l_suppkey AS fn, l_orderkey AS block, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS stmt, l_linestatus AS dst,
  CASE l_returnflag WHEN 'R' THEN 'Eq' WHEN 'A' THEN 'Ne' ELSE 'Lt' END AS op, l_partkey AS x, CASE WHEN l_tax < 0.06 THEN l_linenumber END AS y FROM lineitem"""


@query("last_conditions", f"SELECT fn, block, op, x, y FROM (SELECT *, row_number() OVER (PARTITION BY fn, block ORDER BY stmt DESC) AS r FROM ({COMPARED}) s WHERE dst = 'F') t WHERE r = 1 AND op <> 'Lt' AND y IS NOT NULL")
def _conditions(spark, sf):
    stmts = sql(spark, sf, COMPARED)
    return facts.last_condition(stmts, stmts.select("fn", "block", F.lit("F").alias("local")).distinct())


@query("type_containment", f"SELECT DISTINCT dst AS src, src AS dst, src || '.f' || dst AS step FROM ({HELD}) h WHERE dst < 1000000000")
def _containment(spark, sf):
    held = sql(spark, sf, HELD)
    return facts.containment(held.select(F.col("src").alias("ty"), F.col("dst").alias("type"), F.concat(F.lit("f"), "dst").alias("name"), F.when(F.col("dst") < 1000000000, "struct").otherwise("int").alias("kind")))


CLAIMED = "SELECT DISTINCT l_suppkey AS owner, CAST(l_linenumber AS BIGINT) AS field, l_returnflag AS variant, l_partkey AS tag FROM lineitem WHERE l_linestatus = 'F'"
MORE = CLAIMED.replace("'F'", "'O'")


@query("extended_tags", f"""WITH c AS ({CLAIMED}), n AS (SELECT * FROM ({MORE}) m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.owner = m.owner AND c.field = m.field AND c.tag = m.tag)),
bad AS (SELECT owner, field FROM n GROUP BY owner, field, tag HAVING count(DISTINCT variant) > 1) SELECT * FROM (SELECT * FROM c UNION SELECT * FROM n) a WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.owner = a.owner AND bad.field = a.field)""")
def _extended(spark, sf):
    return facts.extend_tags(sql(spark, sf, CLAIMED), sql(spark, sf, MORE))


@query("remaining_tags", f"""WITH c AS (SELECT DISTINCT owner, tag, variant FROM ({CLAIMED}) x), s AS (SELECT DISTINCT owner, tag FROM ({MORE}) y), v AS (SELECT s_suppkey AS owner, unnest(['A', 'N', 'R', 'X']) AS variant FROM supplier),
f AS (SELECT * FROM s EXCEPT SELECT owner, tag FROM c), b AS (SELECT owner, min(variant) AS variant FROM (SELECT * FROM v EXCEPT SELECT owner, variant FROM c) z GROUP BY owner HAVING count(*) = 1) SELECT f.owner, f.tag, b.variant FROM f LEFT JOIN b ON b.owner = f.owner""")
def _remaining(spark, sf):
    claimed, seen = sql(spark, sf, CLAIMED).select("owner", "variant", "tag").distinct(), sql(spark, sf, MORE).select("owner", "tag")
    suppliers = sql(spark, sf, "SELECT s_suppkey AS owner FROM supplier")
    return facts.remaining_tags(seen, claimed, suppliers.select("owner", F.explode(F.array(*map(F.lit, "ANRX"))).alias("variant")))


@query("tagged_structs", "SELECT o_custkey AS struct, min(o_orderpriority) AS field, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS unions FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
def _structs(spark, sf):
    out = facts.tagged_structs(sql(spark, sf, "SELECT o_custkey AS struct, o_orderkey AS union, o_orderpriority AS field FROM orders"))
    return out.select("struct", "field", F.concat_ws(",", F.col("unions").cast("array<string>")).alias("unions"))


@query("tag_texts", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey * 300007 = 0 THEN 'false' ELSE 'true' END WHEN 'O' THEN CAST((o_orderkey * 300007 + 2147483648) % 4294967296 - 2147483648 AS VARCHAR) ELSE CAST(o_orderkey * 300007 AS VARCHAR) END AS tag FROM orders""")
def _tag_texts(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "bool").when(F.col("o_orderstatus") == "O", "c_int").otherwise("u64")
    return sql(spark, sf, "SELECT o_orderkey, o_orderstatus FROM orders").select("o_orderkey", facts.tag_text(F.col("o_orderkey") * 300007, kind).alias("tag"))


@query("int_arithmetic", """SELECT l_orderkey, l_partkey, ((l_orderkey + l_partkey) % 256 + 256) % 256 AS u8_add, ((l_orderkey - l_partkey) % 65536 + 65536) % 65536 AS u16_sub, l_orderkey // nullif(l_partkey, 0) AS div, l_orderkey % nullif(l_partkey, 0) AS rem,
  (l_orderkey * l_partkey + 2147483648) % 4294967296 - 2147483648 AS i32_mul, xor(l_orderkey, l_partkey) AS x, l_orderkey & l_partkey AS a, l_orderkey | l_partkey AS o, CAST(CASE WHEN l_orderkey >= l_partkey THEN 1 ELSE 0 END AS BIGINT) AS ge FROM lineitem""")
def _arithmetic(spark, sf):
    x, y = F.col("l_orderkey"), F.col("l_partkey")
    op = lambda name, bits=32, signed=True: facts.arithmetic(name, x, y, bits, signed)
    columns = {"u8_add": op("Add", 8, False), "u16_sub": op("Sub", 16, False), "div": op("Div"), "rem": op("Rem"), "i32_mul": op("Mul"), "x": op("BitXor"), "a": op("BitAnd"), "o": op("BitOr"), "ge": op("Ge")}
    return sql(spark, sf, "SELECT * FROM lineitem").select(x, y, *[c.alias(name) for name, c in columns.items()])


@query("span_snippets", "SELECT c_custkey, substr(c_name, 3, 7) AS text FROM customer")
def _snippets(spark, sf):
    c = sql(spark, sf, "SELECT * FROM customer").withColumn("path", F.col("c_custkey").cast("string"))
    out = facts.snippets(c.select("path", F.col("c_name").alias("content")), c.select("path", "c_custkey", F.lit(2).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi")))
    return out.select("c_custkey", "text")


@query("call_sites", """SELECT DISTINCT 'direct' AS kind, l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
UNION SELECT 'allocation', l_suppkey, l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND (l_returnflag = 'A' OR (l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)))""")
def _call_sites(spark, sf):
    calls = sql(spark, sf, """SELECT l_suppkey AS fn, l_orderkey AS block, CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'extern' ELSE 'indirect' END AS kind, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS callee, l_linestatus = 'O' AS dst_is_ptr FROM lineitem""")
    parts = sql(spark, sf, "SELECT p_partkey AS fn, p_size FROM part")
    direct = constraints.direct_calls(calls, parts.filter("p_size > 10"))
    sites = constraints.allocation_sites(calls, parts.filter("p_size > 40").select("fn"))
    return direct.select(F.lit("direct").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).union(sites.select(F.lit("allocation"), "fn", "block"))


@query("setter_writes", """SELECT DISTINCT l_suppkey AS fn, l_orderkey AS block, o_custkey + CAST(l_linenumber AS BIGINT) AS slot FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _setters(spark, sf):
    setters = sql(spark, sf, "SELECT l_suppkey AS fn, l_orderkey AS block, l_orderkey AS loc, l_linenumber AS method FROM lineitem")
    receivers = setters.select("method", F.col("method").cast("long").alias("offset")).distinct()
    return pointsto.bitfield_writes(setters, sql(spark, sf, "SELECT o_orderkey AS loc, o_custkey AS obj FROM orders"), receivers)


@query("dereference_edges", "SELECT o_orderkey AS loc, CAST(unnest(range(coalesce(n_regionkey, 0) + 1)) AS INT) AS depth, o_custkey AS obj FROM orders LEFT JOIN (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) x ON c_custkey = o_custkey")
def _dereferences(spark, sf):
    prefixes = sql(spark, sf, "SELECT c_custkey AS obj, n_regionkey AS most FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0")
    return pointsto.dereferences(sql(spark, sf, "SELECT o_orderkey AS loc, o_custkey AS obj FROM orders"), prefixes)
