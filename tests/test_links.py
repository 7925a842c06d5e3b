"""The links as Spark makes them, branch by branch, against the SQL that defines them."""

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import catalog
from lodestone.plans import fixtures as fx

D = "/root/testdata/sf0.001"


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect()), key=repr) == sorted(map(tuple, b.select(cols).collect()), key=repr)


def test_branches_make_the_rows_of_the_sql(spark):
    same(fx.star_links(spark, D), fx.load(spark, D, fx.EDGES))
    nodes = fx.load(spark, D, fx.NODES)
    for before, edges, kept in ((True, fx.EDGES_BEFORE, fx.NODES_BEFORE), (False, fx.EDGES_AFTER, fx.NODES_AFTER)):
        links = fx.build_links(spark, D, before)
        same(links, fx.load(spark, D, edges))
        same(fx.build_nodes(nodes, links), fx.load(spark, D, kept))


def test_ends_are_made_distinct_before_they_meet_the_nodes(spark):
    nodes, links = fx.load(spark, D, fx.NODES).localCheckpoint(), fx.star_links(spark, D).localCheckpoint()
    lines = graph.external_nodes(nodes, links)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = {word: next(k for k, line in enumerate(lines) if word in line) for word in ("LeftAnti", "Aggregate")}
    assert first["LeftAnti"] < first["Aggregate"]


def with_strays(spark, folder):
    """The tables with keys that no table declares, lines without an order or a part, and a supplier only a pair of lines reaches."""
    for name in "region nation customer supplier part orders lineitem".split():
        df = spark.read.parquet(f"{D}/{name}.parquet").coalesce(1)
        if name == "supplier":
            df = df.where("s_suppkey % 4 <> 1").withColumn("s_nationkey", F.expr("if(s_suppkey = 2, 77, s_nationkey)").cast(df.schema["s_nationkey"].dataType))
        if name == "customer":
            df = df.where("c_custkey % 7 <> 0")
        if name == "orders":
            df = df.where("o_orderkey % 5 <> 0")
        if name == "part":
            df = df.where("p_partkey % 2 = 0")
        if name == "lineitem":
            key = df.schema["l_suppkey"].dataType
            odd = F.expr("case when l_orderkey % 5 = 0 and l_linenumber = 2 then 901 when l_orderkey % 5 = 0 and l_linenumber = 3 then 3 when l_partkey % 9 = 0 then 902 else l_suppkey end")
            df = df.where("l_suppkey <> 3 or l_orderkey % 5 = 0").withColumn("l_suppkey", odd.cast(key))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ends_are_found_without_the_links(spark, tmp_path, monkeypatch):
    strange = with_strays(spark, tmp_path)
    monkeypatch.setattr(fx, "MANY", 1)  # parts as the number of lines asks for
    monkeypatch.setattr(fx, "LINES", 1000)
    nodes, links = fx.load(spark, strange, fx.NODES), fx.load(spark, strange, fx.EDGES)
    same(fx.star_links(spark, strange), links)
    same(graph.external_ends(nodes, fx.star_strays(spark, strange)), graph.external_nodes(nodes, links))
    for before, kept in ((True, fx.NODES_BEFORE), (False, fx.NODES_AFTER)):
        same(fx.nodes_at(nodes, fx.build_ends(spark, strange, before)), fx.load(spark, strange, kept))


def test_nodes_read_no_pairs_of_lines(spark):
    """Links were made for the nodes' sake alone."""
    plan = catalog.QUERIES["world_size"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "l_orderkey" in line]
