"""Registered queries for every family of operators, each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hlc import Hlc
from .functions.ids import attribute_id, id_column, show_id
from .functions.predicates import InvalidQuery
from .functions.values import Ref
from .operators import changes, documents, lww, mvcc, scans, validate
from .plans.compile import Modes, run
from .plans.query import Query, Var
from .sources.store import EngineError, Store
from .sources.triples import COLUMNS, TABLES, TripleSource, open_tables, payload, read_triples, write_triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
V = Var


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, deleted at exit: in spark.checkpoint.dir, which only local sessions may lack."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillon-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _sql_rows() -> str:
    """The triples of all tables, as SQL."""
    parts = []
    for t in TABLES:
        e = f"'{t.name}:' || {t.key}"
        cols = [("id", "str", e), *((c, k, c) for c, k in t.columns.items()), *((c, "ref", f"'{r}:' || {c}") for c, r in t.refs.items())]
        for c, kind, v in cols:
            where = f" WHERE {t.present[c]}" if c in t.present else ""
            pay = [f"CAST({v} AS {ty})" if kind == k else f"CAST(NULL AS {ty})" for k, ty in (("str", "VARCHAR"), ("num", "DOUBLE"), ("bool", "BOOLEAN"), ("ref", "VARCHAR"))]
            parts.append(f"SELECT {e} AS e, '{t.name}/{c}' AS a, '{kind}' AS kind, {pay[0]} AS s, {pay[1]} AS n, {pay[2]} AS b, {pay[3]} AS r FROM {t.name}{where}")
    return "WITH t AS (" + " UNION ALL ".join(parts) + ") "


_T = _sql_rows()


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _stored(spark: SparkSession, sf_dir: str, attributes: list[str]) -> TripleSource:
    """The attributes as rows of triples rather than columns of tables."""
    wide = open_tables(spark, sf_dir)
    out = None
    for a in attributes:
        rows = wide.scan(attribute=a)
        out = rows if out is None else out.unionByName(rows)
    return TripleSource(out)


# --- scans ---


@query(_T + "SELECT e, a, s, n FROM t WHERE e = 'customer:7' AND a = 'customer/c_name'")
def scan_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_tables(spark, sf_dir).scan("customer:7", "customer/c_name").select("e", "a", "s", "n")


@query(_T + "SELECT e, a, kind, s, n, r FROM t WHERE e = 'orders:32'")
def scan_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_tables(spark, sf_dir).scan("orders:32").select("e", "a", "kind", "s", "n", "r")


@query(_T + "SELECT e, n FROM t WHERE a = 'part/p_size'")
def scan_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_tables(spark, sf_dir).scan(attribute="part/p_size").select("e", "n")


@query(_T + "SELECT DISTINCT a FROM t WHERE e = 'supplier:3'")
def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.attributes_of(open_tables(spark, sf_dir).scan("supplier:3"), "supplier:3")


@query(_T + "SELECT count(*) AS n FROM t")
def count_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.count(open_tables(spark, sf_dir).scan())


@query(_T + "SELECT a, count(*) AS n FROM t GROUP BY a")
def full_scan_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run(open_tables(spark, sf_dir), Query(["a"]).must(V("e"), V("a"), V("v")), {"a": "id"})
    return found.groupBy("a").agg(F.count("*").alias("n"))


@query(_T + "SELECT e, a FROM t WHERE a = 'nation/n_name' AND (e, a) >= ('nation:2', 'nation/n_name')")
def scan_from_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.in_key_order(open_tables(spark, sf_dir).scan(attribute="nation/n_name"), ("nation:2", "nation/n_name")).select("e", "a")


@query("SELECT 'part:' || p_partkey AS e, 'part/p_name' AS a FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def index_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys come from a whole table: the parts of all line items."""
    rows = open_tables(spark, sf_dir).scan(attribute="part/p_name")
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct()
    return scans.members(rows, parts.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("e"), F.lit("part/p_name").alias("a")))


# --- patterns ---


@query("SELECT 'customer:' || c_custkey AS c, c_name AS name, c_name AS name_2, CAST(NULL AS VARCHAR) AS nobody FROM customer WHERE c_mktsegment = 'BUILDING'")
def find_dup_and_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "name", "name", "nobody"]).must(V("c"), "customer/c_mktsegment", "BUILDING").must(V("c"), "customer/c_name", V("name"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "name": "str"})


@query("SELECT 'part:' || p_partkey AS p FROM part WHERE p_size = 15")
def match_const_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(open_tables(spark, sf_dir), Query(["p"]).must(V("p"), "part/p_size", 15), {"p": "id"})


@query("SELECT 'supplier:' || s_suppkey AS s FROM supplier WHERE s_nationkey = 3")
def match_const_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(open_tables(spark, sf_dir), Query(["s"]).must(V("s"), "supplier/s_nationkey", Ref("nation:3")), {"s": "id"})


@query("SELECT 'part:' || p_partkey AS p FROM part WHERE abs(p_retailprice - CAST(900.2 AS DOUBLE)) < 2.220446049250313e-16")
def numeric_epsilon_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(open_tables(spark, sf_dir), Query(["p"]).must(V("p"), "part/p_retailprice", 900.2), {"p": "id"})


@query("SELECT 'labels:' || doc_id AS l, CAST(quality AS DOUBLE) AS quality FROM labels WHERE toxic = 1")
def match_const_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["l", "quality"]).must(V("l"), "labels/toxic", True).must(V("l"), "labels/quality", V("quality"))
    return run(open_tables(spark, sf_dir), q, {"l": "id", "quality": "num"})


def _filtered(spark: SparkSession, sf_dir: str, attribute: str, test, form: str) -> DataFrame:
    q = Query(["e", "v"]).must(V("e"), attribute, V("v")).having("v", test)
    return run(open_tables(spark, sf_dir), q, {"e": "id", "v": form})


@query("SELECT 'part:' || p_partkey AS e, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_size > 40")
def filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "part/p_size", lambda v: v.num > 40, "num")


@query("SELECT 'part:' || p_partkey AS e, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_size >= 10 AND p_size <= 20")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "part/p_size", lambda v: (v.num >= 10) & (v.num <= 20), "num")


@query("SELECT 'customer:' || c_custkey AS e, c_mktsegment AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "customer/c_mktsegment", lambda v: v.string.isin("BUILDING", "MACHINERY"), "str")


@query("SELECT 'part:' || p_partkey AS p, p_name AS n, p_type AS ty, p_brand AS b FROM part WHERE starts_with(p_name, 's') AND contains(p_type, 'E') AND ends_with(p_brand, '3')")
def filter_string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["p", "n", "ty", "b"]).must(V("p"), "part/p_name", V("n")).must(V("p"), "part/p_type", V("ty")).must(V("p"), "part/p_brand", V("b"))
    q.having("n", lambda v: v.string.startswith("s")).having("ty", lambda v: v.string.contains("E")).having("b", lambda v: v.string.endswith("3"))
    return run(open_tables(spark, sf_dir), q, {"p": "id", "n": "str", "ty": "str", "b": "str"})


@query("SELECT 'customer:' || c_custkey AS c, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer WHERE NOT coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END = 0, false)")
def filter_not_equals_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "bal"]).must(V("c"), "customer/c_name", V("n")).may(V("c"), "customer/c_acctbal", V("bal"))
    return run(open_tables(spark, sf_dir), q.having("bal", lambda v: ~v.num.eqNullSafe(F.lit(0.0))), {"c": "id", "bal": "num"})


@query("SELECT 'customer:' || c_custkey AS c, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_acctbal >= 0")
def bgp_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "name", "seg", "bal"]).must(V("c"), "customer/c_name", V("name")).must(V("c"), "customer/c_mktsegment", V("seg")).must(V("c"), "customer/c_acctbal", V("bal"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "name": "str", "seg": "str", "bal": "num"})




@query(SQL["bgp_star"])
def bgp_star_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _stored(spark, sf_dir, ["customer/c_name", "customer/c_mktsegment", "customer/c_acctbal"])
    q = Query(["c", "name", "seg", "bal"]).must(V("c"), "customer/c_name", V("name")).must(V("c"), "customer/c_mktsegment", V("seg")).must(V("c"), "customer/c_acctbal", V("bal"))
    return run(source, q, {"c": "id", "name": "str", "seg": "str", "bal": "num"})


@query(SQL["bgp_star"])
def bgp_star_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "name", "seg", "bal"]).must(V("c"), "customer/c_name", V("name")).must(V("c"), "customer/c_mktsegment", V("seg")).must(V("c"), "customer/c_acctbal", V("bal"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "name": "str", "seg": "str", "bal": "num"}, Modes(fuse_stars=False))


@query("SELECT 'customer:' || c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bgp_ref_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "nation", "region"]).must(V("c"), "customer/c_nationkey", V("n")).must(V("n"), "nation/n_name", V("nation"))
    q.must(V("n"), "nation/n_regionkey", V("r")).must(V("r"), "region/r_name", V("region"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "nation": "str", "region": "str"})


@query("SELECT 'nation:' || 1 AS n, 'x' AS name WHERE false")
def bgp_ref_forward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the wire's mode a variable first bound to a reference never stands for the entity."""
    q = Query(["n", "name"]).must(V("c"), "customer/c_nationkey", V("n")).must(V("n"), "nation/n_name", V("name"))
    return run(open_tables(spark, sf_dir), q, {"n": "id", "name": "str"}, Modes(strict_refs=True))


@query("SELECT 'customer:' || c_custkey AS c, n_name AS name, 'region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def bgp_ref_back_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the wire's mode an entity that is met first matches the references that follow."""
    q = Query(["c", "name", "r"]).must(V("n"), "nation/n_name", V("name")).must(V("n"), "nation/n_regionkey", V("r")).must(V("c"), "customer/c_nationkey", V("n"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "name": "str", "r": "id"}, Modes(strict_refs=True))


@query("SELECT n_name AS name, 'supplier:' || s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def bgp_ref_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["name", "s"]).must(V("n"), "nation/n_name", V("name")).must(V("s"), "supplier/s_nationkey", V("n"))
    return run(open_tables(spark, sf_dir), q, {"name": "str", "s": "id"}, Modes(strict_refs=True))


@query("SELECT 'nation:' || s_nationkey AS n, count(*) AS pairs FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY s_nationkey")
def bgp_value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers; pairs are counted by the value they share."""
    q = Query(["n"]).must(V("s"), "supplier/s_nationkey", V("n")).must(V("c"), "customer/c_nationkey", V("n")).must(V("c"), "customer/c_mktsegment", "BUILDING")
    return run(open_tables(spark, sf_dir), q, {"n": "id"}).groupBy("n").agg(F.count("*").alias("pairs"))


@query("SELECT 'part:' || a.p_partkey AS x, 'labels:' || l.doc_id AS y FROM part a JOIN labels l ON a.p_size = l.quality WHERE a.p_size = 1")
def bgp_number_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["x", "y"]).must(V("x"), "part/p_size", V("v")).must(V("y"), "labels/quality", V("v"))
    return run(open_tables(spark, sf_dir), q, {"x": "id", "y": "id"}, Modes(epsilon_joins=True))


@query(_T + "SELECT x.a AS a, count(*) AS n FROM t x JOIN t y ON x.a = y.a WHERE x.e = 'region:1' AND y.e LIKE 'region:%' GROUP BY x.a")
def bgp_attr_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = open_tables(spark, sf_dir)
    q = Query(["a"]).must("region:1", V("a"), V("v")).must(V("e"), V("a"), V("w"))
    return run(wide, q, {"a": "id"}).groupBy("a").agg(F.count("*").alias("n"))


@query("SELECT r_name AS r, n_name AS n FROM region, nation")
def bgp_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(open_tables(spark, sf_dir), Query(["r", "n"]).must(V("x"), "region/r_name", V("r")).must(V("y"), "nation/n_name", V("n")), {"r": "str", "n": "str"})


@query("SELECT 'nation:' || n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey")
def self_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nations.select(F.concat(F.lit("nation:"), "n_nationkey").alias("e"), F.lit("nation/next").alias("a"), F.lit("ref").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.concat(F.lit("nation:"), "n_regionkey").alias("r"))
    return run(TripleSource(rows), Query(["x"]).must(V("x"), "nation/next", V("x")), {"x": "id"})


@query("SELECT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_name IS NOT NULL)")
def ground_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 3").select("n_name")
    wide = open_tables(spark, sf_dir)
    gate = TripleSource(wide.scan("nation:3", "nation/n_name").unionByName(wide.scan(attribute="region/r_name")).join(name.limit(1).select(F.col("n_name").alias("__n")), F.lit(True), "left_semi"))
    return run(gate, Query(["r"]).must("nation:3", "nation/n_name", V("n")).must(V("e"), "region/r_name", V("r")), {"r": "str"})


@query("SELECT 'customer:' || c_custkey AS c, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer")
def optional_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "bal"]).must(V("c"), "customer/id", V("m")).may(V("c"), "customer/c_acctbal", V("bal"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "bal": "num"})


@query("SELECT 'customer:' || c_custkey AS c, 'orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def optional_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "o"]).must(V("c"), "customer/c_name", V("n")).may(V("o"), "orders/o_custkey", V("c"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "o": "id"})


@query("SELECT 'orders:' || o_orderkey AS o, n_name AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def optional_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders."""
    q = Query(["o", "place"]).must(V("o"), "orders/o_custkey", V("c")).may(V("c"), "customer/c_nationkey", V("n")).may(V("n"), "nation/n_name", V("place"))
    return run(open_tables(spark, sf_dir), q, {"o": "id", "place": "str"})


@query("""SELECT 'customer:' || c_custkey AS c, coalesce(CASE WHEN c_acctbal >= 5000 THEN c_name END, n_name) AS v
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 5000 OR c_acctbal >= 5000 AND c_name = n_name
UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 5000 AND c_name <> n_name""")
def optional_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable that the first optional pattern misses is bound by the second; one that is bound is only tested."""
    wide = open_tables(spark, sf_dir)
    rich = wide.frames["customer"].where("c_acctbal >= 5000").select(F.concat(F.lit("customer:"), "c_custkey").alias("e"))
    names = wide.scan(attribute="customer/c_name").join(rich, "e", "left_semi").select(*COLUMNS)
    home = wide.frames["customer"].join(wide.frames["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    home = home.select(F.concat(F.lit("customer:"), "c_custkey").alias("e"), F.lit("customer/home").alias("a"), F.lit("str").alias("kind"), F.col("n_name").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("r"))
    source = TripleSource(names.unionByName(home).unionByName(wide.scan(attribute="customer/id")))
    q = Query(["c", "v"]).must(V("c"), "customer/id", V("m")).may(V("c"), "customer/c_name", V("v")).may(V("c"), "customer/home", V("v"))
    return run(source, q, {"c": "id", "v": "str"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_acctbal < 0")
def where_not_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c"]).must(V("c"), "customer/c_name", V("n")).must_not(V("c"), "customer/c_acctbal", V("x"))
    return run(open_tables(spark, sf_dir), q, {"c": "id"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def where_not_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c"]).must(V("c"), "customer/c_name", V("n")).must_not(V("c"), "customer/c_mktsegment", "BUILDING")
    return run(open_tables(spark, sf_dir), q, {"c": "id"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'")
def where_not_multi_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c"]).must(V("c"), "customer/c_name", V("n")).must_not(V("c"), "customer/c_acctbal", V("x")).must_not(V("c"), "customer/c_mktsegment", "BUILDING")
    return run(open_tables(spark, sf_dir), q, {"c": "id"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def where_not_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c"]).must(V("c"), "customer/c_name", V("n"))
    q.must_not_all((V("o"), "orders/o_custkey", V("c")), (V("o"), "orders/o_orderstatus", "F"))
    return run(open_tables(spark, sf_dir), q, {"c": "id"})


FLAGSHIP = """SELECT 'customer:' || c_custkey AS c, c_name AS name, n_name AS nation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""


@query(FLAGSHIP)
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(["c", "name", "nation", "bal"]).must(V("c"), "customer/c_mktsegment", "BUILDING").must(V("c"), "customer/c_name", V("name"))
    q.may(V("c"), "customer/c_acctbal", V("bal")).may(V("c"), "customer/c_nationkey", V("n")).may(V("n"), "nation/n_name", V("nation"))
    q.must_not_all((V("o"), "orders/o_custkey", V("c")), (V("o"), "orders/o_orderpriority", "1-URGENT"))
    return run(open_tables(spark, sf_dir), q, {"c": "id", "name": "str", "nation": "str", "bal": "num"})


@query("SELECT '#customer:' || c_custkey AS c, ':customer/c_mktsegment' AS a, '\"' || c_mktsegment || '\"' AS v FROM customer")
def display_datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers."""
    rows = open_tables(spark, sf_dir).scan(attribute="customer/c_mktsegment")
    return run(TripleSource(rows), Query(["c", "a", "v"]).must(V("c"), V("a"), V("v")))


# --- documents ---

_SCHEMA = documents.Schema(
    {
        "customer": {"c_name": documents.string(fallback="?"), "c_acctbal": documents.number(optional=True, fallback=-1), "c_mktsegment": documents.string(optional=True), "c_nationkey": documents.ref("nation")},
        "orders": {"o_orderstatus": documents.string(fallback=""), "o_totalprice": documents.number(fallback=0), "o_orderpriority": documents.string(optional=True), "o_custkey": documents.ref("customer")},
        "labels": {"quality": documents.number(fallback=0), "toxic": documents.boolean(fallback=False)},
        "nation": {"n_name": documents.string(fallback=""), "n_regionkey": documents.ref("region")},
        "part": {"p_name": documents.string(fallback=""), "p_brand": documents.string(fallback=""), "p_type": documents.string(fallback=""), "p_size": documents.number(fallback=0), "p_retailprice": documents.number(fallback=0)},
    }
)
_BAL = "CASE WHEN c_acctbal >= 0 THEN c_acctbal END"


def _docs(spark: SparkSession, sf_dir: str, entity: str) -> documents.Documents:
    return documents.Documents(open_tables(spark, sf_dir), _SCHEMA, entity)


@query("SELECT 'customer:' || c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal >= 0")
def is_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "customer").query(["id", "c_acctbal"], {"c_acctbal": {"isDefined": True}})


@query("SELECT 'customer:' || c_custkey AS id, CAST(-1 AS DOUBLE) AS c_acctbal FROM customer WHERE c_acctbal < 0")
def is_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "customer").query(["id", "c_acctbal"], {"c_acctbal": {"isUndefined": True}})


@query(f"SELECT 'customer:' || c_custkey AS id, coalesce({_BAL}, -1.0) AS c_acctbal, c_mktsegment FROM customer")
def fallback_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "customer").query(["id", "c_acctbal", "c_mktsegment"])


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0")
def fallback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "customer").query(["id"], {"c_acctbal": {"equals": -1}})


@query("SELECT 'labels:' || doc_id AS id, CAST(quality AS DOUBLE) AS quality FROM labels WHERE toxic = 1")
def bare_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "labels").query(["id", "quality"], {"toxic": True})


@query("SELECT 'nation:' || n_nationkey AS id, n_name FROM nation")
def entity_type_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.Documents(_stored(spark, sf_dir, ["nation/id", "nation/n_name", "region/id", "region/r_name"]), _SCHEMA, "nation").query(["id", "n_name"])


@query("SELECT 'part:' || p_partkey AS id, p_name FROM part WHERE p_size >= 5 AND p_size < 9 AND contains(p_name, 'e') AND p_brand NOT IN ('Brand#13') AND p_partkey <> 7")
def document_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"p_size": {"greaterThanOrEqual": 5, "lessThan": 9}, "p_name": {"contains": "e"}, "p_brand": {"notIn": ["Brand#13"]}, "id": {"notEquals": "part:7"}}
    return _docs(spark, sf_dir, "part").query(["id", "p_name"], where)


def _ordered(direction: str) -> str:
    return f"SELECT 'customer:' || c_custkey AS id, coalesce({_BAL}, -1.0) AS c_acctbal FROM customer ORDER BY {_BAL} {direction} NULLS LAST, 'customer:' || c_custkey"


@query(_ordered("ASC"))
def order_nulls_last_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, those without a balance last."""
    return _docs(spark, sf_dir, "customer").query(["id", "c_acctbal"], order_by=[("c_acctbal", "asc"), ("id", "asc")])


@query(_ordered("DESC"))
def order_nulls_last_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, those without a balance last."""
    return _docs(spark, sf_dir, "customer").query(["id", "c_acctbal"], order_by=[("c_acctbal", "desc"), ("id", "asc")])


@query("SELECT 'part:' || p_partkey AS id, CAST(p_size AS DOUBLE) AS p_size, p_name FROM part ORDER BY p_size DESC, p_name, 'part:' || p_partkey LIMIT 25")
def order_multi_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").query(["id", "p_size", "p_name"], order_by=[("p_size", "desc"), ("p_name", "asc"), ("id", "asc")], limit=25)


@query("SELECT 'part:' || p_partkey AS id FROM part ORDER BY 'part:' || p_partkey DESC LIMIT 1")
def query_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").query_one(["id"], order_by=[("id", "desc")])


@query(f"SELECT count(*) AS n, count(c_mktsegment) AS seg, min(coalesce({_BAL}, -1.0)) AS lo, max(c_acctbal) AS hi FROM customer")
def agg_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "customer").aggregate({"n": ("count", "*"), "seg": ("count", "c_mktsegment"), "lo": ("min", "c_acctbal"), "hi": ("max", "c_acctbal")})


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total, CAST(round(avg(o_totalprice)) AS BIGINT) AS mean FROM orders GROUP BY ALL ORDER BY n DESC LIMIT 100")
def agg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir, "orders").aggregate({"n": ("count", "*"), "total": ("sum", "o_totalprice"), "mean": ("avg", "o_totalprice")}, ["o_orderstatus", "o_orderpriority"], order_by=[("n", "desc")], limit=100)
    return out.withColumn("total", F.round("total").cast("bigint")).withColumn("mean", F.round("mean").cast("bigint"))


@query("""WITH r AS (SELECT o_custkey, 'orders:' || o_orderkey AS id, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'orders:' || o_orderkey) AS n FROM orders)
SELECT 'customer:' || c_custkey AS id, c_name, string_agg(r.id || '=' || CAST(round(r.o_totalprice) AS BIGINT), ',' ORDER BY n) AS top FROM customer LEFT JOIN r ON o_custkey = c_custkey AND n <= 3 GROUP BY c_custkey, c_name""")
def relation_nested_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir, "customer").related(["id", "c_name"], _docs(spark, sf_dir, "orders"), "o_custkey", ["id", "o_totalprice"], "orders", ("o_totalprice", "desc"), 3)
    shown = F.array_join(F.transform("orders", lambda o: F.concat(o["id"], F.lit("="), F.round(o["o_totalprice"]).cast("bigint").cast("string"))), ",")
    return out.select("id", "c_name", shown.alias("top"))


@query("SELECT 'part:' || p_partkey AS id, p_name, p_retailprice FROM part WHERE p_retailprice > 940 OR p_retailprice = 940 AND 'part:' || p_partkey > 'part:400' ORDER BY p_retailprice, 'part:' || p_partkey LIMIT 40")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").page(["p_name", "p_retailprice"], "p_retailprice", 40, after=(940.0, "part:400"))


@query(_T + "SELECT e, a, kind, s, n, r FROM t WHERE e LIKE 'nation:%'")
def create_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), "n_name", F.concat(F.lit("region:"), "n_regionkey").alias("n_regionkey"))
    return _docs(spark, sf_dir, "nation").create(rows).select("e", "a", "kind", "s", "n", "r")


@query("SELECT 'part:' || p_partkey AS e, 'part/p_retailprice' AS a, p_retailprice + p_size AS n FROM part WHERE p_size > 45")
def update_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").update_many({"p_size": {"greaterThan": 45}}, {"p_retailprice": F.col("p_retailprice") + F.col("p_size")}).select("e", "a", "n")


@query(_T + "SELECT e, a FROM t WHERE e IN (SELECT 'labels:' || doc_id FROM labels WHERE toxic = 1) AND a LIKE 'labels/%'")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "labels").delete_many({"toxic": True})


# --- writes, versions, feed ---

_UPDATES = """WITH u AS (SELECT (event_id * 7919 % 10007) * 10000000 + event_id AS arrival, 'user:' || user_id AS e, 'events/' || event_type AS a, value AS n,
  epoch_us(ts) // 1000 AS p, event_id % 3 AS l, user_id % 5 AS node, event_id FROM events) """
_ACCEPTED = _UPDATES + """, d AS (SELECT *, max((p, l, node)) OVER (PARTITION BY e, a ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM u) """


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of one value a user and type, in permuted order of arrival."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = lambda t: F.lit(None).cast(t)
    arrival = ((F.col("event_id") * 7919) % 10007) * 10_000_000 + F.col("event_id")
    return ev.select(arrival.cast("bigint").alias("arrival"), F.concat(F.lit("user:"), "user_id").alias("e"), F.concat(F.lit("events/"), "event_type").alias("a"), F.lit("num").alias("kind"), none("string").alias("s"), F.col("value").cast("double").alias("n"), none("boolean").alias("b"), none("string").alias("r"), F.unix_millis(F.col("ts").cast("timestamp")).cast("decimal(20,0)").alias("hlc_p"), (F.col("event_id") % 3).cast("bigint").alias("hlc_l"), (F.col("user_id") % 5).cast("bigint").alias("hlc_n"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of the accepted updates and some deletions: a transaction is 50 arrivals, every seventh isn't committed."""
    acc = lww.decide(updates(spark, sf_dir)).where("outcome <> 'reject'")
    txn = (F.col("arrival") / 10_000_000).cast("bigint")
    kind = F.when((F.col("outcome") == "update") & (F.col("hlc_l") == 2) & (F.col("hlc_n") == 1), "DELETE").otherwise(F.upper("outcome"))
    ops = acc.select(F.col("arrival").alias("lsn"), (F.floor(txn / 50) + 1).cast("bigint").alias("txn"), kind.alias("type"), "e", "a", *lww.PAYLOAD, *lww.TIME, (F.col("hlc_n")).alias("src_conn"))
    marks = ops.select("txn").distinct().where("txn % 7 <> 0")
    none = lambda t: F.lit(None).cast(t)
    types = dict(ops.dtypes)
    commits = marks.select((F.col("txn") * 500_000_000 + 499_999_999).alias("lsn"), "txn", F.lit("COMMIT").alias("type"), *[none(types[c]).alias(c) for c in ops.columns[3:]])
    return ops.unionByName(commits)


_LOG = _ACCEPTED + """, ops AS (SELECT arrival AS lsn, CAST(floor((arrival // 10000000) / 50) + 1 AS BIGINT) AS txn,
  CASE WHEN top IS NULL THEN 'INSERT' WHEN l = 2 AND node = 1 THEN 'DELETE' ELSE 'UPDATE' END AS type, e, a, n, p, l, node
  FROM d WHERE top IS NULL OR (p, l, node) > top) """


@query(_UPDATES + "SELECT e, a, arg_max(n, (p, l, node)) AS n, max(p) AS p FROM u GROUP BY e, a")
def lww_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.latest(updates(spark, sf_dir)).select("e", "a", "n", F.col("hlc_p").cast("bigint").alias("p"))


@query(_ACCEPTED + "SELECT event_id AS id, CASE WHEN top IS NULL THEN 'insert' WHEN (p, l, node) > top THEN 'update' ELSE 'reject' END AS outcome FROM d")
def lww_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.decide(updates(spark, sf_dir)).select((F.col("arrival") % 10_000_000).alias("id"), "outcome")


@query(_UPDATES + ", h AS (SELECT e, a, max((p, l, node)) AS top FROM u WHERE event_id % 2 = 0 GROUP BY e, a) SELECT u.event_id AS id, CASE WHEN h.top IS NULL THEN 'insert' WHEN (p, l, node) > h.top THEN 'update' ELSE 'reject' END AS outcome FROM u LEFT JOIN h ON u.e = h.e AND u.a = h.a WHERE event_id % 2 = 1")
def lww_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = updates(spark, sf_dir)
    id = F.col("arrival") % 10_000_000
    return lww.decide_at_once(u.where(id % 2 == 1), lww.latest(u.where(id % 2 == 0))).select(id.alias("id"), "outcome")


@query(_UPDATES + ", s AS (SELECT e, a, arg_max(n, (p, l, node)) AS n FROM u GROUP BY e, a) SELECT event_id AS seq, event_id // 10 AS request_id, s.n FROM u JOIN s ON u.e = s.e AND u.a = s.a")
def lww_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = updates(spark, sf_dir).withColumn("seq", F.col("arrival") % 10_000_000).withColumn("request_id", F.floor(F.col("seq") / 10).cast("bigint"))
    return lww.respond(u, lww.latest(u.drop("seq", "request_id")).select("e", "a", "n")).select("seq", "request_id", "n")


@query(_UPDATES + ", s AS (SELECT e, a, arg_max(n, (p, l, node)) AS n, count(*) AS c FROM u GROUP BY e, a) SELECT e, a, n FROM s")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = updates(spark, sf_dir)
    id = F.col("arrival") % 10_000_000
    stored = lww.latest(u.where(id % 2 == 0)).drop("arrival")
    return lww.merge(stored, u.where(id % 2 == 1)).select("e", "a", "n")


@query("""SELECT doc_id AS seq, doc_id // 20 AS request_id, CASE WHEN strlen(text) > 1024 OR strlen(text) < 1 THEN 'string_length' ELSE '' END AS errors,
  max(CASE WHEN strlen(text) > 1024 OR strlen(text) < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id // 20) = 0 AS request_ok FROM documents""")
def validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch = d.select(F.floor(F.col("doc_id") / 20).cast("bigint").alias("request_id"), F.col("doc_id").alias("seq"), id_column(F.concat(F.lit("doc"), "doc_id")).alias("e"), id_column(F.lit("documents/text")).alias("a"), F.lit("str").alias("kind"), F.col("text").alias("s"), F.lit(1).alias("hlc_p"), F.lit(0).alias("hlc_l"), F.lit(0).alias("hlc_n"))
    return validate.validate(batch).select("seq", "request_id", F.array_join("errors", ",").alias("errors"), "request_ok")


@query("SELECT c_custkey AS k, substr(c_name, 1, 16) AS shown FROM customer")
def id_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("k"), show_id(id_column(F.col("c_name"))).alias("shown"))


_VERSIONS = _LOG + """, v AS (SELECT *, coalesce(lead(txn) OVER (PARTITION BY e, a ORDER BY lsn), 0) AS deleted_txn FROM (
  SELECT *, row_number() OVER (PARTITION BY e, a, txn ORDER BY lsn DESC) AS k FROM ops) WHERE k = 1), ver AS (SELECT e, a, n, txn AS created_txn, deleted_txn FROM v WHERE type <> 'DELETE') """


@query(_VERSIONS + "SELECT e, a, n FROM ver WHERE created_txn <= 120 AND (deleted_txn = 0 OR deleted_txn > 120)")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.snapshot(mvcc.versions(log(spark, sf_dir)), 120).select("e", "a", "n")


@query(_VERSIONS + "SELECT CASE WHEN deleted_txn = 0 THEN 'live' WHEN deleted_txn < 100 THEN 'collectable' ELSE 'held' END AS state, count(*) AS n FROM ver GROUP BY 1")
def garbage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.garbage_stats(mvcc.versions(log(spark, sf_dir)), 100)


@query(_VERSIONS + ", x AS (SELECT e, a, n, created_txn, CASE WHEN deleted_txn = 0 AND e = 'user:3' THEN 1000 ELSE deleted_txn END AS deleted_txn FROM ver) SELECT e, a, n, created_txn, deleted_txn FROM x WHERE NOT (deleted_txn <> 0 AND deleted_txn < 150)")
def delete_and_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mvcc.delete_entity(mvcc.versions(log(spark, sf_dir)), "user:3", 1000)
    return mvcc.collect_garbage(rows, 150).select("e", "a", "n", "created_txn", "deleted_txn")


@query(_LOG + "SELECT e, a, n FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY lsn DESC) AS k FROM ops WHERE txn % 7 <> 0) WHERE k = 1 AND type <> 'DELETE'")
def recover_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.recover(log(spark, sf_dir)).select("e", "a", "n")


_SINCE = "(SELECT CAST(avg(epoch_us(ts) // 1000) AS BIGINT) // 1000 * 1000 FROM events)"


def _middle(spark: SparkSession, sf_dir: str) -> int:
    return int(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.round(F.avg(F.unix_millis(F.col("ts").cast("timestamp")))).cast("bigint")).first()[0]) // 1000 * 1000


@query(_LOG + f"SELECT lsn, type AS change_type, e, a, CASE WHEN type <> 'DELETE' THEN n END AS n FROM ops WHERE p >= {_SINCE}")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.since_time(changes.to_changes(log(spark, sf_dir)), Hlc(_middle(spark, sf_dir), 0, 99)).select("lsn", "change_type", "e", "a", "n")


@query(_LOG + "SELECT type AS change_type, count(*) AS n FROM ops GROUP BY type")
def change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.to_changes(log(spark, sf_dir)).groupBy("change_type").agg(F.count("*").alias("n"))


@query(_LOG + "SELECT lsn, e, a FROM ops WHERE node <> 2")
def own_write_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.others(changes.to_changes(log(spark, sf_dir)), 2).select("lsn", "e", "a")


@query(_LOG + "SELECT lsn, txn, type FROM ops WHERE lsn >= 50000000000")
def wal_from_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.since_position(log(spark, sf_dir), 50_000_000_000).where("type <> 'COMMIT'").select("lsn", "txn", "type")


@query(_ACCEPTED + "SELECT event_id AS id, CASE WHEN top IS NULL THEN 'insert' WHEN (p, l, node) > top THEN 'update' ELSE 'reject' END AS outcome FROM d")
def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions by a stream with keyed state, drained into a table."""
    from .streaming import feed

    base = _scratch(spark, "stream")
    updates(spark, sf_dir).write.parquet(f"{base}/in")
    feed.drain(feed.stream_lww(feed.read_log(spark, f"{base}/in", feed.UPDATES)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select((F.col("arrival") % 10_000_000).alias("id"), "outcome")


@query("SELECT CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import windowed_counts

    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed_counts(ev, "ts", ["event_type"], "1 hour").select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "n")



@query(_LOG + "SELECT lsn, type AS change_type, e, a, CASE WHEN type <> 'DELETE' THEN n END AS n FROM ops WHERE node <> 2")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription drained into a table: live changes of others, from a log that is read as a stream."""
    from .streaming import feed

    base = _scratch(spark, "feed")
    rows = log(spark, sf_dir)
    rows.write.parquet(f"{base}/in")
    feed.drain(feed.live_changes(feed.read_log(spark, f"{base}/in", rows.schema.simpleString()[7:-1].replace(":", " ")), 2), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("lsn", "change_type", "e", "a", "n")


@query(_VERSIONS + ", g AS (SELECT *, row_number() OVER (ORDER BY deleted_txn, e, a, created_txn) AS k FROM ver WHERE deleted_txn <> 0 AND deleted_txn < 150) SELECT e, a, n, created_txn FROM ver WHERE NOT EXISTS (SELECT 1 FROM g WHERE k <= 100 AND g.e = ver.e AND g.a = ver.a AND g.created_txn = ver.created_txn)")
def gc_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.collect_batch(mvcc.versions(log(spark, sf_dir)), 100, 150).select("e", "a", "n", "created_txn")


@query(_T + "SELECT s.s AS name, t.s AS nation FROM t s JOIN t r ON r.e = s.e AND r.a = 'supplier/s_nationkey' JOIN t ON t.e = r.r AND t.a = 'nation/n_name' WHERE s.a = 'supplier/s_name'")
def union_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a shared store and one's own."""
    from .session import union_sources

    shared = _stored(spark, sf_dir, ["nation/id", "nation/n_name"])
    own = _stored(spark, sf_dir, ["supplier/s_name", "supplier/s_nationkey"])
    q = Query(["name", "nation"]).must(V("s"), "supplier/s_name", V("name")).must(V("s"), "supplier/s_nationkey", V("n")).must(V("n"), "nation/n_name", V("nation"))
    return run(union_sources(shared, own), q, {"name": "str", "nation": "str"})


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, count(*) AS n, CAST(min(t) // 1000000 AS BIGINT) AS began FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import session_counts

    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return session_counts(ev, "ts", ["user_id"], "2 hours").select("user_id", "n", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("began"))


@query("SELECT 'part:' || p_partkey AS p, p_name AS name, CAST(p_size AS DOUBLE) AS size FROM part WHERE p_size > 30")
def stored_star_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written by attribute folder and read back: the query's attributes prune folders."""
    base = _scratch(spark, "triples")
    wide = open_tables(spark, sf_dir)
    write_triples(wide.scan(attribute="part/p_name").unionByName(wide.scan(attribute="part/p_size")).unionByName(wide.scan(attribute="part/p_brand")), base)
    q = Query(["p", "name", "size"]).must(V("p"), "part/p_name", V("name")).must(V("p"), "part/p_size", V("size")).having("size", lambda v: v.num > 30)
    return run(read_triples(spark, base), q, {"p": "id", "name": "str", "size": "num"})


# --- paging, ids, legality, stores ---


@query("SELECT 'part:' || p_partkey AS id, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE (p_size < 30 OR p_size = 30 AND p_name > 'a' OR p_size = 30 AND p_name = 'a' AND 'part:' || p_partkey > 'part:1') ORDER BY p_size DESC, p_name, 'part:' || p_partkey LIMIT 30")
def page_after_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").page(["p_name", "p_size"], [("p_size", "desc"), ("p_name", "asc")], 30, after=(30.0, "a", "part:1"))


@query("SELECT * FROM (SELECT 'customer:' || c_custkey AS id, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, -1.0) AS c_acctbal FROM customer WHERE c_acctbal >= 0 AND (c_acctbal < 900 OR c_acctbal = 900 AND 'customer:' || c_custkey < 'customer:5') ORDER BY c_acctbal DESC, 'customer:' || c_custkey DESC LIMIT 25)")
def page_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous page: the rows before the first one seen, nearest first in the SQL, in page order here."""
    return _docs(spark, sf_dir, "customer").page(["c_acctbal"], [("c_acctbal", "asc")], 25, before=(900.0, "customer:5"))


@query("SELECT count(*) AS n, CAST(ceil(count(*) / 40.0) AS BIGINT) AS pages FROM part WHERE p_size > 10")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").page_totals(40, {"p_size": {"greaterThan": 10}})


@query("SELECT 'part:' || p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_name, 'part:' || p_partkey LIMIT 25")
def order_by_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").query(["id"], order_by=[("p_retailprice", "desc"), ("p_name", "asc"), ("id", "asc")], limit=25)


@query("SELECT 'orders:' || o_orderkey AS e, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1994-06-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1996'")
def filter_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates are text; ISO dates sort as they should."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = orders.select(F.concat(F.lit("orders:"), "o_orderkey").alias("e"), F.lit("orders/day").alias("a"), *payload(day, "str"))
    q = Query(["e", "day"]).must(V("e"), "orders/day", V("day")).having("day", lambda v: (v.string >= "1994-06-01") & (v.string < "1996"))
    return run(TripleSource(rows), q, {"e": "id", "day": "str"})


_ATTRIBUTES = [f"{t.name}/{c}" for t in TABLES for c in ("id", *t.columns, *t.refs)]
_HASHED = "CAST(list_reduce([CAST({} AS UHUGEINT)] || list_transform(string_split(a, ''), lambda x: CAST(ord(x) AS UHUGEINT)), lambda h, b: xor(h, b) * 16777619 % 18446744073709551616) AS VARCHAR)"


@query("WITH n(a) AS (VALUES " + ", ".join(f"('{a}')" for a in _ATTRIBUTES) + f") SELECT a, {_HASHED.format(0xCBF29CE484222325)} AS low, {_HASHED.format(0x84222325CBF29CE4)} AS high FROM n")
def attribute_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all attributes, as their two numbers."""
    made = [(a, *(str(int.from_bytes(attribute_id(a)[i : i + 8], "little")) for i in (0, 8))) for a in _ATTRIBUTES]
    return spark.createDataFrame(made, "a string, low string, high string")


@query(_LOG + "SELECT type, count(*) AS n FROM ops WHERE lsn % 5 <> 0 GROUP BY type")
def intact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with checksums of which every fifth is changed afterwards."""
    signed = mvcc.with_checksum(log(spark, sf_dir).where("type <> 'COMMIT'"))
    return mvcc.intact(signed.withColumn("hlc_l", F.when(F.col("lsn") % 5 == 0, F.col("hlc_l") + 1).otherwise(F.col("hlc_l")))).groupBy("type").agg(F.count("*").alias("n"))


_TESTS = ("equals", "notEquals", "contains", "startsWith", "endsWith", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual", "in", "notIn", "isDefined", "isUndefined")


@query(f"""SELECT kind, test, CASE WHEN test IN ('equals', 'notEquals', 'in', 'notIn', 'isDefined', 'isUndefined') THEN true WHEN test IN ('contains', 'startsWith', 'endsWith') THEN kind = 'string' ELSE kind = 'number' END AS legal
FROM (SELECT unnest(['string', 'number', 'boolean', 'ref']) AS kind), (SELECT unnest({list(_TESTS)}) AS test)""")
def filter_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which predicates a field's kind takes, as queries over documents find out."""
    fields = {"string": ("part", "p_name", "x"), "number": ("part", "p_size", 1), "boolean": ("labels", "toxic", True), "ref": ("customer", "c_nationkey", "nation:1")}
    found = []
    for kind, (entity, name, arg) in fields.items():
        for test in _TESTS:
            given = [arg] if test in ("in", "notIn") else True if test.startswith("is") else arg
            try:
                _docs(spark, sf_dir, entity).query(["id"], {name: {test: given}})
                found.append((kind, test, True))
            except InvalidQuery:
                found.append((kind, test, False))
    return spark.createDataFrame(found, "kind string, test string, legal boolean")


@query("""SELECT how, field, CASE WHEN how NOT IN ('count', 'sum', 'avg', 'min', 'max') THEN false WHEN field = '*' THEN how = 'count' WHEN how IN ('sum', 'avg') THEN field = 'c_acctbal' ELSE true END AS legal
FROM (SELECT unnest(['count', 'sum', 'avg', 'min', 'max', 'median']) AS how), (SELECT unnest(['*', 'c_acctbal', 'c_name']) AS field)""")
def aggregate_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _docs(spark, sf_dir, "customer"), []
    for how in ("count", "sum", "avg", "min", "max", "median"):
        for name in ("*", "c_acctbal", "c_name"):
            try:
                docs.aggregate({"x": (how, name)})
                found.append((how, name, True))
            except InvalidQuery:
                found.append((how, name, False))
    return spark.createDataFrame(found, "how string, field string, legal boolean")


@query(_VERSIONS + "SELECT count(*) AS n FROM ver")
def count_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, the ended ones too."""
    return scans.count(mvcc.versions(log(spark, sf_dir)))


@query(_VERSIONS + "SELECT a, n FROM ver WHERE deleted_txn = 0 AND e = 'user:3' UNION ALL SELECT 'entities', count(DISTINCT e) FROM ver WHERE deleted_txn = 0 AND a = (SELECT min(a) FROM ver)")
def current_state_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writing transaction reads: live rows of an entity, and the entities of an attribute."""
    live = scans.snapshot(mvcc.versions(log(spark, sf_dir)))
    first = mvcc.versions(log(spark, sf_dir)).agg(F.min("a").alias("a"))
    own = live.join(F.broadcast(first), "a", "left_semi").select("e").distinct()
    return scans.entity(live, "user:3").select("a", "n").unionByName(own.agg(F.lit("entities").alias("a"), F.count("*").cast("double").alias("n")))


@query(_VERSIONS + "SELECT 120 AS held, count(*) AS n FROM ver WHERE NOT (deleted_txn <> 0 AND deleted_txn < 120) UNION ALL SELECT 90, count(*) FROM ver WHERE NOT (deleted_txn <> 0 AND deleted_txn < 90) UNION ALL SELECT 0, count(*) FROM ver WHERE deleted_txn = 0")
def held_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbage collection spares what the oldest held snapshot sees; 0 stands for none held."""
    rows, held, out = mvcc.versions(log(spark, sf_dir)), mvcc.Snapshots(), None
    for step, txn in ((held.acquire, 120), (held.acquire, 90), (held.release, 90), (held.release, 120)):
        step(txn)
        if step == held.release and txn == 90:
            continue
        left = mvcc.collect_garbage(rows, held.min_active).agg(F.lit(held.min_active or 0).alias("held"), F.count("*").alias("n"))
        out = left if out is None else out.unionByName(left)
    return out


@query("SELECT DISTINCT source AS key, regexp_full_match(source, '[A-Za-z0-9_-]{1,256}') AS ok FROM documents UNION SELECT DISTINCT c_name, regexp_full_match(c_name, '[A-Za-z0-9_-]{1,256}') FROM customer")
def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("key")).unionByName(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("key")))
    return keys.distinct().select("key", validate.valid_api_key(F.col("key")).alias("ok"))


def _filled_store(spark: SparkSession, sf_dir: str, root: str) -> Store:
    """Two commits of updates by two connections, and two that must not count: an empty one and one that is refused."""
    store, u, even = Store(spark, root, "app"), updates(spark, sf_dir), (F.col("arrival") % 10_000_000) % 2 == 0
    store.upsert(u.where(even), 1)
    store.upsert(u.limit(0), 1)
    late = Store(spark, root, "app")
    publish = late._publish

    def refused(mark: dict) -> None:
        store.upsert(u.where(~even), 2)
        publish(mark)

    late._publish = refused
    try:
        late.upsert(u.withColumn("n", F.lit(-1.0)).withColumn("hlc_p", (F.col("hlc_p") + 10**9).cast("decimal(20,0)")), 3)
    except EngineError:
        return store
    raise AssertionError("a writer that came too late was not refused")


_STORED = _UPDATES + """, top AS (SELECT e, a, max((p, l, node)) AS t, arg_max(n, (p, l, node)) AS n FROM u WHERE event_id % 2 = 0 GROUP BY e, a),
o AS (SELECT u.*, t, max((p, l, node)) OVER (PARTITION BY u.e, u.a ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u LEFT JOIN top ON u.e = top.e AND u.a = top.a WHERE event_id % 2 = 1),
fresh AS (SELECT * FROM o WHERE (t IS NULL OR (p, l, node) > t) AND (b IS NULL OR (p, l, node) > b)) """


@query(_UPDATES + "SELECT e, a, arg_max(n, (p, l, node)) AS n FROM u GROUP BY e, a")
def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates, an empty batch and a refused writer: the live rows."""
    return _filled_store(spark, sf_dir, _scratch(spark, "commits")).source().scan().select("e", "a", "n")


@query(_STORED + "SELECT e, a, n, 1 AS created_txn FROM top UNION ALL SELECT e, a, arg_max(n, (p, l, node)), 2 FROM fresh GROUP BY e, a")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of the same store, read from a base written between the commits and the operations behind it."""
    store = _filled_store(spark, sf_dir, _scratch(spark, "versions"))
    store.compact(min_active=1)
    return store.rows().select("e", "a", "n", "created_txn")


@query(_UPDATES + "SELECT e, a, arg_max(n, (p, l, node)) AS n FROM u WHERE a <> 'events/click' GROUP BY e, a")
def store_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one attribute are deleted in a transaction of their own."""
    store = _filled_store(spark, sf_dir, _scratch(spark, "deletes"))
    gone = store.source().scan(attribute="events/click").select("e", "a")
    if not gone.isEmpty():
        store.delete(gone, Hlc(2**50))
    return store.source().scan().select("e", "a", "n")


@query(_STORED + "SELECT 'first' AS listener, CASE WHEN t IS NULL AND b IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type, e, a, n FROM fresh UNION ALL SELECT 'second', CASE WHEN t IS NULL AND b IS NULL THEN 'INSERT' ELSE 'UPDATE' END, e, a, n FROM fresh")
def store_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listeners of the first connection hear what the second committed, and nothing of the refused writer."""
    from .session import Engine

    base = _scratch(spark, "listen")
    engine = Engine(spark, f"{base}/data")
    _filled_store(spark, sf_dir, f"{base}/data")
    me = engine.connect().open("app")
    for name in ("first", "second"):
        each = lambda batch, name=name: batch.withColumn("listener", F.lit(name)).write.mode("append").parquet(f"{base}/heard")
        me.subscribe(name, each, f"{base}/checkpoint-{name}").awaitTermination()
        me.unsubscribe(name)
    return spark.read.parquet(f"{base}/heard").select("listener", "change_type", "e", "a", "n")


@query("""WITH d AS (SELECT doc_id // 3 AS request_id, doc_id AS seq, 'doc:' || doc_id AS e, text AS s, strlen(text) > 1024 OR strlen(text) < 1 AS bad FROM documents),
b AS (SELECT request_id, min(seq) AS seq FROM d WHERE bad GROUP BY request_id)
SELECT request_id, seq, s, CAST(NULL AS VARCHAR) AS error FROM d WHERE request_id NOT IN (SELECT request_id FROM b) UNION ALL SELECT request_id, seq, NULL, 'string_length' FROM b""")
def session_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection opens its store, sends requests of three documents each, and hears of each what is stored or wrong."""
    from .session import Engine

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = lambda t: F.lit(None).cast(t)
    requests = d.select(F.floor(F.col("doc_id") / 3).cast("bigint").alias("request_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("arrival"), F.concat(F.lit("doc:"), "doc_id").alias("e"), F.lit("documents/text").alias("a"), F.lit("str").alias("kind"), F.col("text").alias("s"), none("double").alias("n"), none("boolean").alias("b"), F.lit(1).cast("decimal(20,0)").alias("hlc_p"), F.lit(0).cast("bigint").alias("hlc_l"), F.lit(0).cast("bigint").alias("hlc_n"))
    me = Engine(spark, _scratch(spark, "session")).connect().open("app")
    return me.update(requests).select("request_id", "seq", "s", "error")


def _formats(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    base = _scratch(spark, form)
    rows = open_tables(spark, sf_dir).scan(attribute="supplier/s_name").unionByName(open_tables(spark, sf_dir).scan(attribute="supplier/s_acctbal"))
    write_triples(rows, base, form)
    q = Query(["s", "name", "bal"]).must(V("s"), "supplier/s_name", V("name")).may(V("s"), "supplier/s_acctbal", V("bal"))
    return run(read_triples(spark, base, form=form), q, {"s": "id", "name": "str", "bal": "num"})


_SUPPLIERS = "SELECT 'supplier:' || s_suppkey AS s, s_name AS name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS bal FROM supplier"


@query(_SUPPLIERS)
def triples_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir, "json")


@query(_SUPPLIERS)
def triples_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir, "csv")


@query(_SUPPLIERS)
def triples_as_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir, "orc")
