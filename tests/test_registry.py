"""Queries over whole driver tables, against brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from factloom.operators import graph
from factloom.plans import registry

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """A folder with a sparse lineitem table (several components, cycles and levels), and its edges."""
    r, folder, table = random.Random(4), tmp_path_factory.mktemp("lines"), []
    for order in range(36):
        start, up = r.randrange(40), r.random() < 0.9
        for n in range(r.randint(1, 4)):
            supplier = min(start + 8 * n, 47) if up else max(start - 8 * n, 0)
            values = [n + 1, r.randrange(50), supplier, float(r.randint(1, 47)), 1.0, 0.02, 0.03, r.choice("ANR"), "O", order]
            table.append({"l_orderkey": order, **dict(zip(LINE, values))})
    pq.write_table(pa.Table.from_pylist(table), folder / "lineitem.parquet")
    neighbours = zip(table, table[1:])
    return str(folder), {(a["l_suppkey"], b["l_suppkey"]) for a, b in neighbours if a["l_orderkey"] == b["l_orderkey"] and a["l_suppkey"] != b["l_suppkey"]}


def reach(edges, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        new = {b for a, b in edges if a == v and b != without} - seen
        seen |= new
        todo += new
    return seen


def test_graph_queries_use_all_lines(spark, lines):
    folder, edges = lines
    run = lambda name: rows_of(registry.QUERIES[name](spark, folder))
    assert len(edges) > 30 and run("edge_inverse") == sorted((b, a) for a, b in edges)
    both = edges | {(b, a) for a, b in edges}
    assert run("symmetric_closure") == sorted(both)
    all_ = sorted({v for e in edges for v in e})
    closure = {(v, w) for v in all_ for b in {b for a, b in edges if a == v} for w in reach(edges, b)}
    assert run("transitive_closure") == sorted(closure)
    preds = {v: {a for a, b in edges if b == v} for v in all_}
    assert run("join_points") == sorted((v, len(p)) for v, p in preds.items() if len(p) > 1)
    assert run("connected_components") == [(v, min(reach(both, v))) for v in all_]
    label = {v: min([v] + [w for w in all_ if (v, w) in closure and (w, v) in closure]) for v in all_}
    assert run("scc_label") == sorted(label.items())
    dag = {(label[a], label[b]) for a, b in edges if label[a] != label[b]}
    assert dag and run("condensation") == sorted(dag)
    level = dict.fromkeys(label.values(), 0)
    for _ in level:
        level = {v: max([level[b] + 1 for a, b in dag if a == v], default=0) for v in level}
    assert run("topo_level") == sorted(level.items())
    entry = min(a for a, _ in edges)
    live = reach(edges, entry)
    assert run("reachable_from") == sorted((v,) for v in live)
    dom = {(d, v) for d in live for v in live if d == v or d == entry or v not in reach(edges, entry, d)}
    assert run("dominators") == sorted(dom)
    assert run("back_edges") == sorted((a, b) for a, b in edges if (b, a) in dom)


def test_tags_use_all_lines(spark, tmp_path):
    """Lines of any quantity count: without the small ones, owner 1 has no field of two variants, and owner 2 has a sound one."""
    lines = [(1, 1, "A", 7, 3.0), (1, 1, "R", 8, 45.0), (2, 1, "A", 5, 50.0), (2, 1, "R", 6, 50.0), (2, 1, "N", 5, 1.0)]
    columns = ["l_suppkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity"]
    pq.write_table(pa.Table.from_pylist([dict(zip(columns, x)) for x in lines]), tmp_path / "lineitem.parquet")
    assert rows_of(registry.QUERIES["fd_tag_discovery"](spark, str(tmp_path))) == [(1, 1, 2)]


def test_simple_paths_of_any_length(spark):
    edges = [(i, i + 1) for i in range(7)] + [(7, 0), (2, 5), (5, 3), (9, 1)]

    def grown(path):
        for b in (b for a, b in edges if a == path[-1] and b not in path):
            yield [*path, b]
            yield from grown([*path, b])

    expected = sorted((p[0], p[-1], ">".join(map(str, p)), len(p) - 1) for v in sorted({v for e in edges for v in e}) for p in grown([v]))
    e = spark.createDataFrame(edges, "src long, dst long")
    assert max(p[3] for p in expected) > 4 and rows_of(graph.simple_paths(e, graph.vertices(e))) == expected


def test_shuffles_grow_with_the_tables(spark, monkeypatch):
    """A task's share of a larger table stays as it is: there are more partitions, never fewer than are set."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        registry.sql(spark, "/root/testdata/sf0.001", registry.E)
        assert spark.conf.get(name) == before
        monkeypatch.setattr(registry, "DEALT", 1000)
        registry.sql(spark, "/root/testdata/sf0.001", registry.E)
        assert int(spark.conf.get(name)) > int(before)
    finally:
        spark.conf.set(name, before)


def test_task_sizes_are_bounded(spark, tmp_path):
    """What is put together for a task is bounded for the session, unless somebody has set it."""
    from factloom.plans import registry

    kept = {name: spark.conf.get(name) for name in registry.TOGETHER}
    first, second = registry.TOGETHER
    try:
        spark.conf.unset(first)
        spark.conf.set(second, "7000000b")
        registry.deal(spark, [str(tmp_path)])
        assert spark.conf.get(first) == f"{registry.TOGETHER[first]}b" and spark.conf.get(second) == "7000000b"
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
