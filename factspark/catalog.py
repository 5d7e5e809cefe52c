"""Registered queries: one for each operator, over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import DatomSource
from .edn import Keyword
from .facts import Facts, clashes, from_lines, init_facts
from .operators.pull import pull_df
from .query import q_df
from .sources import tpch_tables
from .values import ANY, to_any

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def datalog(name: str, query: str, sql: str | None, *inputs: Any) -> None:
    """Registers a query over the mapped tables; inputs after the source are given as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = tpch_tables(spark, sf_dir)
        given = [x(db, spark, sf_dir) if callable(x) and getattr(x, "late", False) else x for x in inputs]
        return q_df(query, db, *given, spark=spark)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def late(f: Callable) -> Callable:
    f.late = True
    return f


def plain(name: str, run: Run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# ---- patterns, joins, predicates

HEAD = '[:find ?name ?price :where [?o :orders/o_custkey ?c] [?c :customer/c_name ?name] [?o :orders/o_totalprice ?price] [(> ?price 400000.0)]]'
datalog("pattern_join", HEAD, "SELECT DISTINCT c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
datalog("pattern_const", '[:find ?name ?bal :where [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_name ?name] [?c :customer/c_acctbal ?bal]]', "SELECT DISTINCT c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
datalog("pattern_attr_var", '[:find ?a ?n :where [?c :nation/n_name ?n] [?c ?a _]]', "SELECT DISTINCT a, n_name AS n FROM nation, (VALUES (':nation/n_nationkey'), (':nation/n_name'), (':nation/n_regionkey')) t(a)")
datalog("find_rel", '[:find ?seg ?st :where [?o :orders/o_custkey ?c] [?c :customer/c_mktsegment ?seg] [?o :orders/o_orderstatus ?st]]', "SELECT DISTINCT c_mktsegment AS seg, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey")
datalog("find_coll", '[:find [?seg ...] :where [_ :customer/c_mktsegment ?seg]]', "SELECT DISTINCT c_mktsegment AS seg FROM customer")
datalog("find_tuple", '[:find [(min ?p) (max ?p)] :where [_ :orders/o_totalprice ?p]]', "SELECT min(o_totalprice) AS min_p, max(o_totalprice) AS max_p FROM orders")
datalog("find_scalar", '[:find (count ?o) . :where [?o :orders/o_orderstatus "F"]]', "SELECT count(*) AS count_o FROM orders WHERE o_orderstatus = 'F'")
datalog("return_keys", '[:find ?n ?r :keys nation region :where [?x :nation/n_name ?n] [?x :nation/n_regionkey ?y] [?y :region/r_name ?r]]', "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
datalog("return_syms", '[:find ?n ?b :syms supplier balance :where [?s :supplier/s_name ?n] [?s :supplier/s_acctbal ?b]]', "SELECT DISTINCT s_name AS supplier, s_acctbal AS balance FROM supplier")
datalog("return_strs", '[:find ?b ?t :strs "brand" "kind" :where [?p :part/p_brand ?b] [?p :part/p_type ?t]]', "SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part")
datalog("with_clause", '[:find ?st ?pr :with ?o :where [?o :orders/o_orderstatus ?st] [?o :orders/o_orderpriority ?pr]]', "SELECT o_orderstatus AS st, o_orderpriority AS pr FROM orders")
datalog("pred", '[:find ?k ?q :where [?p :part/p_partkey ?k] [?p :part/p_size ?q] [(< 10 ?q 20)]]', "SELECT DISTINCT p_partkey AS k, p_size AS q FROM part WHERE p_size > 10 AND p_size < 20")
datalog("pred_multi_rel", '[:find ?a ?b :where [?x :nation/n_name ?a] [?y :region/r_name ?b] [(not= ?a ?b)] [(compare ?a ?b) ?c] [(!= ?c 0)]]', "SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region WHERE n_name <> r_name")
datalog("cross_join", '[:find ?a ?b :where [?x :nation/n_name ?a] [?y :region/r_name ?b]]', "SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region")
datalog("theta_join", '[:find ?a ?b :where [?x :supplier/s_suppkey ?a] [?x :supplier/s_nationkey ?n] [?x :supplier/s_acctbal ?p] [?y :customer/c_nationkey ?n] [?y :customer/c_custkey ?b] [?y :customer/c_acctbal ?q] [(> ?p ?q)]]', "SELECT s_suppkey AS a, c_custkey AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
datalog("graph_join", '[:find ?r (count ?o) :where [?o :orders/o_custkey ?c] [?c :customer/c_nationkey ?n] [?n :nation/n_regionkey ?g] [?g :region/r_name ?r]]', "SELECT r_name AS r, count(*) AS count_o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
datalog("hash_join", '[:find ?k ?d :where [?l :lineitem/l_orderkey ?o] [?o :orders/o_orderkey ?k] [?o :orders/o_orderdate ?d] [?l :lineitem/l_quantity 1.0]]', "SELECT DISTINCT o_orderkey AS k, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 1.0")
datalog("left_join_default", '[:find ?k ?q :where [?d :documents/doc_id ?k] [(get-else $ ?d :documents/lang "none") ?q]]', "SELECT doc_id AS k, coalesce(lang, 'none') AS q FROM documents")
datalog("lookup_ref_const", '[:find ?k :where [?o :orders/o_custkey [:customer/c_custkey 7]] [?o :orders/o_orderkey ?k]]', "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 7")
datalog("lookup_ref_var", '[:find ?k :in $ ?c :where [?o :orders/o_custkey ?c] [?o :orders/o_orderkey ?k]]', "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 11", [Keyword(":customer/c_custkey"), 11])

datalog("lookup_ref_coll", '[:find ?k :in $ [?c ...] :where [?o :orders/o_custkey ?c] [?o :orders/o_orderkey ?k]]', "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (11, 12)", [[Keyword(":customer/c_custkey"), 11], [Keyword(":customer/c_custkey"), 12]])

# ---- inputs

datalog("in_scalar", '[:find ?k :in $ ?seg :where [?c :customer/c_mktsegment ?seg] [?c :customer/c_custkey ?k]]', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'", "MACHINERY")
datalog("in_coll", '[:find ?k :in $ [?seg ...] :where [?c :customer/c_mktsegment ?seg] [?c :customer/c_custkey ?k]]', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')", ["MACHINERY", "BUILDING"])
datalog("in_tuple", '[:find ?k :in $ [?seg ?low] :where [?c :customer/c_mktsegment ?seg] [?c :customer/c_acctbal ?b] [(> ?b ?low)] [?c :customer/c_custkey ?k]]', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000", ["MACHINERY", 5000.0])
datalog("in_rel", '[:find ?seg ?k :in $ [[?seg ?low]] :where [?c :customer/c_mktsegment ?seg] [?c :customer/c_acctbal ?b] [(> ?b ?low)] [?c :customer/c_custkey ?k]]', "SELECT c_mktsegment AS seg, c_custkey AS k FROM customer JOIN (VALUES ('MACHINERY', 5000.0), ('BUILDING', 9000.0)) t(s, low) ON c_mktsegment = s AND c_acctbal > low", [["MACHINERY", 5000.0], ["BUILDING", 9000.0]])
datalog("in_nested", '[:find ?t ?n :in $ [[?t [?lo ?hi]] ...] :where [?p :part/p_type ?t] [?p :part/p_size ?s] [(<= ?lo ?s ?hi)] [?p :part/p_name ?n]]', "SELECT DISTINCT p_type AS t, p_name AS n FROM part JOIN (SELECT min(p_type) AS a, max(p_type) AS b FROM part) ON (p_type = a AND p_size BETWEEN 1 AND 7) OR (p_type = b AND p_size BETWEEN 2 AND 4)",
        late(lambda db, spark, d: (lambda r: {r[0]: [1, 7], r[1]: [2, 4]})(spark.read.parquet(f"{d}/part.parquet").agg(F.min("p_type"), F.max("p_type")).first())))
datalog("multi_source", '[:find ?n ?x :in $ $b :where [?c :customer/c_custkey ?k] [?c :customer/c_name ?n] [$b ?k ?x]]', "SELECT c_name AS n, c_custkey * 10 AS x FROM customer WHERE c_custkey IN (1, 2, 3)", [(1, 10), (2, 20), (3, 30)])
datalog("pattern_source", '[:find ?k :in $ $b :where [$b ?k _] [$b _ ?k]]', "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey IN (SELECT n_regionkey FROM nation)", late(lambda db, spark, d: spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long"))))


def scan_coll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long"), F.lit(":name"), "n_name")
    return q_df('[:find ?e ?v :where [?e _ ?v] [(> ?e 3)]]', rows, spark=spark)


plain("scan_coll", scan_coll, "SELECT n_nationkey::BIGINT AS e, n_name AS v FROM nation WHERE n_nationkey > 3")

# ---- aggregates (over distinct rows of find and with)

def agg(name: str, call: str, sql: str, with_: bool = False) -> None:
    datalog(name, f"[:find ?b {call} {':with ?p' if with_ else ''} :where [?p :part/p_brand ?b] [?p :part/p_size ?x]]", sql)


D = "FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand"
agg("agg_sum", "(sum ?x)", f"SELECT p_brand AS b, sum(p_size)::BIGINT AS sum_x {D}")
agg("agg_avg", "(avg ?x)", f"SELECT p_brand AS b, avg(p_size) AS avg_x {D}")
agg("agg_median", "(median ?x)", f"SELECT p_brand AS b, median(p_size)::DOUBLE AS median_x {D}")


def rounded(name: str, call: str, column: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q_df(f"[:find ?b {call} :where [?p :part/p_brand ?b] [?p :part/p_size ?x]]", tpch_tables(spark, sf_dir), spark=spark)
        return df.withColumn(column, F.round(column, 6))

    plain(name, run, sql)


rounded("agg_variance", "(variance ?x)", "variance_x", f"SELECT p_brand AS b, round(var_pop(p_size), 6) AS variance_x {D}")
rounded("agg_stddev", "(stddev ?x)", "stddev_x", f"SELECT p_brand AS b, round(stddev_pop(p_size), 6) AS stddev_x {D}")
agg("agg_distinct", "(distinct ?x)", f"SELECT p_brand AS b, list_sort(list(p_size)) AS distinct_x {D}")
agg("agg_min", "(min ?x)", f"SELECT p_brand AS b, min(p_size) AS min_x {D}")
agg("agg_max", "(max ?x)", f"SELECT p_brand AS b, max(p_size) AS max_x {D}")
agg("agg_min_n", "(min 3 ?x)", f"SELECT p_brand AS b, list_sort(list(p_size))[1:3] AS min_x {D}")
agg("agg_max_n", "(max 3 ?x)", f"SELECT p_brand AS b, list_sort(list_slice(list_reverse_sort(list(p_size)), 1, 3)) AS max_x {D}")
agg("agg_count", "(count ?x)", f"SELECT p_brand AS b, count(*) AS count_x {D}")
agg("agg_count_distinct", "(count-distinct ?x)", "SELECT p_brand AS b, count(DISTINCT p_size) AS \"count-distinct_x\" FROM part GROUP BY p_brand", True)
agg("agg_with", "(sum ?x)", "SELECT p_brand AS b, sum(p_size)::BIGINT AS sum_x FROM part GROUP BY p_brand", True)
agg("agg_group", "(min ?x) (max ?x) (count ?x)", f"SELECT p_brand AS b, min(p_size) AS min_x, max(p_size) AS max_x, count(*) AS count_x {D}")
datalog("agg_empty", '[:find (sum ?x) (count ?x) :where [?p :part/p_size ?x] [(> ?x 1000)]]', "SELECT sum(p_size)::BIGINT AS sum_x, count(*) AS count_x FROM part WHERE p_size > 1000 HAVING count(*) > 0")
datalog("agg_custom_var", "[:find ?b (aggregate ?f ?x) :in $ ?f :where [?p :part/p_brand ?b] [?p :part/p_size ?x]]", f"SELECT p_brand AS b, sum(p_size * p_size)::BIGINT AS f_x {D}", lambda c: F.sum(c.cast("long") * c))
datalog("agg_custom_sym", "[:find ?b (factspark.catalog/spread ?x) :where [?p :part/p_brand ?b] [?p :part/p_size ?x]]", f"SELECT p_brand AS b, max(p_size) - min(p_size) AS \"factspark.catalog_spread_x\" {D}")


def spread(c: Any) -> Any:
    return F.max(c) - F.min(c)


for _n, _call in (("agg_rand", "(rand ?x)"), ("agg_rand_n", "(rand 2 ?x)"), ("agg_sample", "(sample 3 ?x)")):
    agg(_n, _call, "")
    ORACLE_SQL.pop(_n, None)


def agg_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = q_df("[:find (pull ?n [:nation/n_name]) (count ?c) :where [?c :customer/c_nationkey ?n]]", tpch_tables(spark, sf_dir), spark=spark)
    return df.select(F.col("pull_n.n_name").alias("n_name"), "count_c")


plain("agg_pull", agg_pull, "SELECT n_name, count(*) AS count_c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

# ---- or, and, not

datalog("or_union", '[:find ?k :where [?c :customer/c_custkey ?k] (or [?c :customer/c_mktsegment "BUILDING"] [?c :customer/c_nationkey [:nation/n_nationkey 3]])]', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
datalog("or_join", '[:find ?k :where [?c :customer/c_custkey ?k] (or-join [?c] [?c :customer/c_mktsegment "BUILDING"] (and [?o :orders/o_custkey ?c] [?o :orders/o_totalprice ?p] [(> ?p 450000.0)]))]', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
datalog("or_join_required", '[:find ?k ?l :where [?c :customer/c_custkey ?k] [?c :customer/c_acctbal ?b] (or-join [[?b] ?l] (and [(< ?b 0.0)] [(ground "debt") ?l]) (and [(>= ?b 9000.0)] [(ground "rich") ?l]))]', "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'rich' END AS l FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 9000")
datalog("and_group", '[:find ?k :where [?p :part/p_partkey ?k] (or [?p :part/p_size 1] (and [?p :part/p_size 2] [?p :part/p_brand "Brand#11"]))]', "SELECT p_partkey AS k FROM part WHERE p_size = 1 OR (p_size = 2 AND p_brand = 'Brand#11')")
datalog("not_exists", '[:find ?k :where [?d :documents/doc_id ?k] (not [_ :labels/doc_id ?d])]', "SELECT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
datalog("not_join", '[:find ?k :where [?c :customer/c_custkey ?k] (not-join [?c] [?o :orders/o_custkey ?c] [?o :orders/o_orderstatus "P"])]', "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
datalog("nested_not", '[:find ?k :where [?p :part/p_partkey ?k] (not [?p :part/p_size ?s] (not [(< ?s 10)]))]', "SELECT p_partkey AS k FROM part WHERE NOT (p_size >= 10)")
datalog("anti_join", '[:find ?k :where [?s :supplier/s_suppkey ?k] (not [?l :lineitem/l_suppkey ?s] [?l :lineitem/l_returnflag "R"] [?l :lineitem/l_quantity 50.0])]', "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)")
datalog("semi_join", '[:find ?k :where [?p :part/p_partkey ?k] (or-join [?p] (and [?l :lineitem/l_partkey ?p] [?l :lineitem/l_quantity 50.0]))]', "SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")

# ---- rules over a graph of all parts: part k div 2 leads to k, so that reach grows with the table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("p_partkey div 2").alias("a"), F.col("p_partkey").cast("long").alias("b"))


EDGES = "e AS (SELECT (p_partkey // 2)::BIGINT AS a, p_partkey::BIGINT AS b FROM part)"
CLOSURE = f"WITH RECURSIVE {EDGES}, t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)"
_REACH = "[[(reach ?a ?b) [?a ?b]] [(reach ?a ?b) [?a ?t] (reach ?t ?b)]]"
for _name, _q, _sql, _rules, _more in (
    ("rule_simple", "[:find ?x ?y :in $ % :where (step ?x ?y)]", f"WITH {EDGES} SELECT a AS x, b AS y FROM e", "[[(step ?a ?b) [?a ?b]]]", ()),
    ("rule_branches", "[:find ?x ?y :in $ % :where (near ?x ?y)]", f"WITH {EDGES} SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e", "[[(near ?a ?b) [?a ?b]] [(near ?a ?b) [?b ?a]]]", ()),
    ("rule_recursive", "[:find ?x ?y :in $ % :where (reach ?x ?y)]", f"{CLOSURE} SELECT a AS x, b AS y FROM t", _REACH, ()),
    ("rule_const_arg", "[:find ?y :in $ % :where (reach 3 ?y)]", f"{CLOSURE} SELECT b AS y FROM t WHERE a = 3", _REACH, ()),
    ("rule_bound_var", "[:find ?x ?y :in $ % [?x ...] :where (reach ?x ?y)]", f"{CLOSURE} SELECT a AS x, b AS y FROM t WHERE a IN (3, 5, 8)", _REACH, ([3, 5, 8],)),
    ("rule_bound_end", "[:find ?x :in $ % :where (reach ?x 150)]", f"{CLOSURE} SELECT a AS x FROM t WHERE b = 150", _REACH, ()),
    ("rule_mutual", "[:find ?x ?y :in $ % :where (odd ?x ?y)]", f"WITH RECURSIVE {EDGES}, t(a, b, p) AS (SELECT a, b, 1 FROM e UNION SELECT t.a, e.b, 1 - t.p FROM t JOIN e ON t.b = e.a) SELECT DISTINCT a AS x, b AS y FROM t WHERE p = 1",
     "[[(odd ?a ?b) [?a ?b]] [(odd ?a ?b) [?a ?t] (even ?t ?b)] [(even ?a ?b) [?a ?t] (odd ?t ?b)]]", ()),
    ("rule_pred_arg", "[:find ?x :in $ % ?p :where (pick ?p ?x)]", f"WITH {EDGES} SELECT DISTINCT a AS x FROM e WHERE a % 3 = 0", "[[(pick ?p ?a) [?a _] [(?p ?a)]]]", (lambda c: c % 3 == 0,)),
):
    plain(_name, (lambda q, rules, more: lambda spark, d: q_df(q, edges(spark, d), rules, *more, spark=spark))(_q, _rules, _more), _sql)


def rule_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_df("[:find ?x ?n :in $ $g % :where ($g step ?x ?y) [?p :part/p_partkey ?y] [?p :part/p_name ?n]]", tpch_tables(spark, sf_dir), edges(spark, sf_dir), "[[(step ?a ?b) [?a ?b]]]", spark=spark)


plain("rule_source", rule_source, f"WITH {EDGES} SELECT DISTINCT a AS x, p_name AS n FROM e JOIN part ON p_partkey = b")

# ---- functions: over parts (?k key, ?s size, ?n name, ?r price) unless they need others

def fn(name: str, clauses: str, sql: str, find: str = "?k ?o") -> None:
    datalog(name, f"[:find {find} :where [?p :part/p_partkey ?k] [?p :part/p_size ?s] [?p :part/p_name ?n] [?p :part/p_retailprice ?r] {clauses}]", f"SELECT DISTINCT p_partkey AS k, {sql}")


fn("fn_eq", "[(= ?s 7)]", "p_size AS s FROM part WHERE p_size = 7", "?k ?s")
fn("fn_num_eq", "[(== ?s 7.0)]", "p_size AS s FROM part WHERE p_size = 7", "?k ?s")
fn("fn_ne", "[(not= ?s 7)]", "p_size AS s FROM part WHERE p_size <> 7", "?k ?s")
fn("fn_lt", "[(< ?s 7)]", "p_size AS s FROM part WHERE p_size < 7", "?k ?s")
fn("fn_gt", "[(> 10 ?s 7)]", "p_size AS s FROM part WHERE 10 > p_size AND p_size > 7", "?k ?s")
fn("fn_le", "[(<= ?s 7)]", "p_size AS s FROM part WHERE p_size <= 7", "?k ?s")
fn("fn_ge", '[(>= ?n "a" 5)] [(>= ?s 40)]', "p_size AS s FROM part WHERE p_size >= 40 AND p_name >= 'a'", "?k ?s")
fn("fn_arith", "[(+ ?s 2 ?k) ?a] [(* ?a 3) ?b] [(- ?b ?k) ?o]", "((p_size + 2 + p_partkey) * 3 - p_partkey)::BIGINT AS o FROM part")
fn("fn_div", "[(/ ?s 4) ?o]", "p_size / 4.0::DOUBLE AS o FROM part")
fn("fn_quot", "[(- ?s 25) ?a] [(quot ?a 7) ?o]", "((p_size - 25) // 7)::BIGINT AS o FROM part")
ORACLE_SQL["fn_quot"] = "SELECT DISTINCT p_partkey AS k, trunc((p_size - 25) / 7.0)::BIGINT AS o FROM part"
fn("fn_rem", "[(- ?s 25) ?a] [(rem ?a 7) ?o]", "((p_size - 25) % 7)::BIGINT AS o FROM part")
fn("fn_mod", "[(- ?s 25) ?a] [(mod ?a 7) ?o]", "((((p_size - 25) % 7) + 7) % 7)::BIGINT AS o FROM part")
fn("fn_inc_dec", "[(inc ?s) ?a] [(dec ?k) ?b] [(+ ?a ?b) ?o]", "(p_size + p_partkey)::BIGINT AS o FROM part")
fn("fn_max_min", "[(max ?s 10) ?a] [(min ?a 20) ?o]", "least(greatest(p_size, 10), 20)::BIGINT AS o FROM part")
fn("fn_sign", "[(- ?s 25) ?a] [(neg? ?a)] [(- ?a 1) ?o]", "(p_size - 26)::BIGINT AS o FROM part WHERE p_size < 25")
fn("fn_parity", "[(even? ?s)] [(odd? ?k)]", "p_size AS s FROM part WHERE p_size % 2 = 0 AND p_partkey % 2 = 1", "?k ?s")
fn("fn_compare", "[(compare ?s 25) ?o]", "CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END::BIGINT AS o FROM part")
fn("fn_bool", "[(> ?s 25) ?b] [(true? ?b)] [(some? ?n)] [(not= ?b false) ?o]", "true AS o FROM part WHERE p_size > 25")
fn("fn_and_or", "[(> ?s 25) ?a] [(< ?s 30) ?b] [(and ?a ?b) ?o]", "(p_size > 25 AND p_size < 30) AS o FROM part")
fn("fn_identity", "[(identity ?s) ?o]", "p_size AS o FROM part")
fn("fn_identical", "[(identical? ?s 5)]", "p_size AS s FROM part WHERE p_size = 5", "?k ?s")
fn("fn_keyword", '[(keyword ?n) ?w] [(name ?w) ?o]', "regexp_extract(p_name, '([^/]*)$', 1) AS o FROM part")
fn("fn_name", '[(str ":" ?n "/" ?s) ?w] [(name ?w) ?o]', "p_size::VARCHAR AS o FROM part")
fn("fn_namespace", '[(str ":" ?n "/" ?s) ?w] [(namespace ?w) ?o]', "p_name AS o FROM part")
fn("fn_type", "[(type ?s) ?o]", "':long' AS o FROM part")
fn("fn_vector", "[(vector ?k ?s) ?v] [(untuple ?v) [?a ?o]]", "p_size::BIGINT AS o FROM part")
fn("fn_set", "[(vector ?s ?s 3) ?v] [(set ?v) ?w] [(count ?w) ?o]", "(CASE WHEN p_size = 3 THEN 1 ELSE 2 END)::BIGINT AS o FROM part")
fn("fn_count", "[(count ?n) ?o]", "length(p_name)::BIGINT AS o FROM part")
fn("fn_range", "[(< ?s 4)] [(range ?s) [?o ...]]", "o::BIGINT AS o FROM part, range(4) t(o) WHERE p_size < 4 AND o < p_size")
fn("fn_empty", '[(subs ?n 0 0) ?e] [(empty? ?e)] [(not-empty ?n) ?o]', "p_name AS o FROM part WHERE p_name <> ''")
fn("fn_contains", "[(contains? #{1 2 3} ?s)]", "p_size AS s FROM part WHERE p_size IN (1, 2, 3)", "?k ?s")
fn("fn_str", '[(str ?n "-" ?s) ?o]', "p_name || '-' || p_size AS o FROM part")
fn("fn_subs", "[(subs ?n 1 3) ?o]", "substr(p_name, 2, 2) AS o FROM part")
fn("fn_get", '[(get {1 "one", 2 "two"} ?s) ?o]', "CASE p_size WHEN 1 THEN 'one' ELSE 'two' END AS o FROM part WHERE p_size IN (1, 2)")
fn("fn_print", '[(print-str ?n) ?a] [(println-str ?n) ?b] [(prn-str ?n) ?c] [(pr-str ?n) ?d] [(str ?a ?b ?c ?d) ?o]', "p_name || p_name || chr(10) || '\"' || p_name || '\"' || chr(10) || '\"' || p_name || '\"' AS o FROM part")
fn("fn_re_find", '[(re-find "[aeiou].." ?n) ?o]', "regexp_extract(p_name, '[aeiou]..') AS o FROM part WHERE regexp_matches(p_name, '[aeiou]..')")
fn("fn_re_pattern", '[(re-pattern "[aeiou]..") ?w] [(re-find ?w ?n) ?o]', "regexp_extract(p_name, '[aeiou]..') AS o FROM part WHERE regexp_matches(p_name, '[aeiou]..')")
fn("fn_re_matches", '[(re-matches ".*[a-m]" ?n) ?o]', "p_name AS o FROM part WHERE regexp_full_match(p_name, '.*[a-m]')")
fn("fn_re_seq", '[(re-seq "[0-9]" ?n) ?v] [(count ?v) ?o]', "len(regexp_extract_all(p_name, '[0-9]'))::BIGINT AS o FROM part")
fn("fn_differ", "[(-differ? ?s 5)]", "p_size AS s FROM part WHERE p_size <> 5", "?k ?s")
fn("fn_ground", "[(ground [1 2]) [?o ...]] [(< ?s 3)]", "o FROM part, (VALUES (1::BIGINT), (2)) t(o) WHERE p_size < 3")
fn("fn_blank", '[(get {1 "", 2 " ", 3 "x"} ?s) ?e] [(clojure.string/blank? ?e)]', "p_size AS s FROM part WHERE p_size IN (1, 2)", "?k ?s")
fn("fn_includes", '[(clojure.string/includes? ?n "re")]', "p_size AS s FROM part WHERE contains(p_name, 're')", "?k ?s")
fn("fn_starts", '[(clojure.string/starts-with? ?n "b")]', "p_size AS s FROM part WHERE starts_with(p_name, 'b')", "?k ?s")
fn("fn_ends", '[(clojure.string/ends-with? ?n "e")]', "p_size AS s FROM part WHERE ends_with(p_name, 'e')", "?k ?s")
fn("fn_untuple", "[(tuple ?s ?k) ?t] [(untuple ?t) [?a ?b]] [(+ ?a ?b) ?o]", "(p_size + p_partkey)::BIGINT AS o FROM part")
fn("fn_bind", "[(vector ?s 1) [?o _]]", "p_size::BIGINT AS o FROM part")
datalog("fn_get_else", '[:find ?k ?q :where [?d :documents/doc_id ?k] [(get-else $ ?d :documents/source "none") ?q]]', "SELECT doc_id AS k, source AS q FROM documents")
datalog("fn_missing", '[:find ?k :where [?d :documents/doc_id ?k] [(missing? $ ?d :labels/_doc_id)]]', "SELECT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
datalog("fn_get_some", '[:find ?k ?a ?v :where [?d :documents/doc_id ?k] [(get-some $ ?d :documents/source :documents/lang) [?a ?v]]]', "SELECT doc_id AS k, ':documents/source' AS a, source AS v FROM documents")
fn("fn_rand", "[(rand) ?q] [(< ?q 2.0)] [(rand-int 10) ?w] [(< ?w 10)]", "p_size AS s FROM part", "?k ?s")
fn("fn_map", '[(array-map "a" ?s "b" ?s) ?m] [(get ?m "b") ?o]', "p_size AS o FROM part")
datalog("fn_meta", "[:find (count ?k) :where [?p :part/p_partkey ?k] (not [(meta ?k) ?o])]", "SELECT count(*) AS count_k FROM part")
datalog("fn_complement", "[:find ?k :in $ ?f :where [?p :part/p_partkey ?k] [?p :part/p_size ?s] (not [(?f ?s)])]", "SELECT p_partkey AS k FROM part WHERE NOT p_size > 30", lambda c: c > 30)

# ---- fact stores: index access, filters, diff, changes


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts (e, a, v tagged, tx)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    values = F.array(*[F.struct(F.lit(f":{n}").alias("a"), to_any(F.col(f"c_{n}"), k).alias("v")) for n, k in (("name", "string"), ("acctbal", "double"), ("nationkey", "long"))])
    return c.select((F.col("c_custkey") + 1).alias("e"), F.explode(values).alias("x")).select("e", "x.a", F.col("x.v").cast(ANY).alias("v"), F.lit(536870913).cast("long").alias("tx"))


FACTS = "f AS (SELECT c_custkey + 1 AS e, ':name' AS a, c_name AS v FROM customer UNION ALL SELECT c_custkey + 1, ':nationkey', c_nationkey::VARCHAR FROM customer)"


def shown(df: DataFrame) -> DataFrame:
    return df.select("e", "a", F.coalesce("v.str", F.col("v.lng").cast("string")).alias("v"))


def few(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).filter("a in (':name', ':nationkey')")


plain("scan_eav", lambda s, d: q_df("[:find ?e ?v :where [?e :name ?v] [?e :nationkey 5]]", DatomSource.of_frame(s, facts(s, d)), spark=s), "SELECT c_custkey + 1 AS e, c_name AS v FROM customer WHERE c_nationkey = 5")


def rows_of(df: DataFrame, e: Column, **attrs: tuple[Column, str]) -> DataFrame:
    """Facts (e, a, v, tx) of a table: a column and its kind for each attribute."""
    values = F.array(*[F.struct(F.lit(f":{n}").alias("a"), to_any(c, k).cast(ANY).alias("v")) for n, (c, k) in attrs.items()])
    return df.select(e.cast("long").alias("e"), F.explode(values).alias("x")).select("e", "x.a", "x.v", F.lit(536870913).cast("long").alias("tx"))


def ident_const(spark: SparkSession, d: str) -> DataFrame:
    """Regions as named entities that nations refer to by name."""
    regions = rows_of(spark.read.parquet(f"{d}/region.parquet"), F.col("r_regionkey") + 1000, **{"db/ident": (F.concat(F.lit(":region/r"), F.col("r_regionkey")), "keyword")})
    nations = rows_of(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey"), name=(F.col("n_name"), "string"))
    links = rows_of(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey"), region=((F.col("n_regionkey") + 1000).cast("long"), "long"))
    source = DatomSource.of_frame(spark, regions.unionByName(nations).unionByName(links), {":region": {":db/valueType": ":db.type/ref"}})
    return q_df("[:find ?n :where [?e :region :region/r1] [?e :name ?n]]", source, spark=spark)


plain("ident_const", ident_const, "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
plain("pattern_tx", lambda s, d: q_df("[:find ?e ?tx :where [?e :nationkey 5 ?tx]]", DatomSource.of_frame(s, facts(s, d)), spark=s), "SELECT c_custkey + 1 AS e, 536870913::BIGINT AS tx FROM customer WHERE c_nationkey = 5")
plain("init_db", lambda s, d: init_facts(facts(s, d).unionByName(facts(s, d))).stats(), "SELECT a, count(*) AS n, max(c_custkey + 1) AS max_eid FROM customer, (VALUES (':name'), (':acctbal'), (':nationkey')) t(a) GROUP BY a")


def _index(name: str, sql: str, *args: Any) -> None:
    from .operators import index

    plain(name, lambda s, d: shown(getattr(index, name)(few(s, d), *args)), sql)


_index("datoms", f"WITH {FACTS} SELECT e, a, v FROM f WHERE a = ':nationkey'", "aevt", ":nationkey")
_index("find_datom", f"WITH {FACTS} SELECT e, a, v FROM f WHERE a = ':name' ORDER BY e LIMIT 1", "aevt", ":name")
_index("seek_datoms", f"WITH {FACTS} SELECT e, a, v FROM f WHERE a > ':name' OR (a = ':name' AND e >= 1400)", "aevt", ":name", 1400)
_index("rseek_datoms", f"WITH {FACTS} SELECT e, a, v FROM f WHERE a < ':name' OR (a = ':name' AND e <= 100)", "aevt", ":name", 100)
_index("index_range", f"WITH {FACTS} SELECT e, a, v FROM f WHERE a = ':nationkey' AND v::INT BETWEEN 3 AND 6", ":nationkey", 3, 6)
plain("filter_db", lambda s, d: q_df("[:find ?e ?v :where [?e :name ?v]]", DatomSource.of_frame(s, facts(s, d)).filtered(F.col("e") > 100).filtered(F.col("e") < 200), spark=s), "SELECT c_custkey + 1 AS e, c_name AS v FROM customer WHERE c_custkey + 1 > 100 AND c_custkey + 1 < 200")


def db_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts against a version without the nation 5 and with 99 for the nation 7."""
    from .operators.index import diff

    base = few(spark, sf_dir)
    nation = F.when(F.col("a") == ":nationkey", F.col("v.lng"))
    moved = nation.eqNullSafe(7)
    after = base.filter(~nation.eqNullSafe(5) & ~moved).unionByName(_set_nation(base.filter(moved), 99))
    found = diff(base, after)
    return found.select("side", "e", "a", F.coalesce("v.str", F.col("v.lng").cast("string")).alias("v"))


plain("db_diff", db_diff, f"WITH {FACTS} SELECT CASE WHEN a = ':nationkey' AND v IN ('5', '7') THEN 'a' ELSE 'both' END AS side, e, a, v FROM f UNION ALL SELECT 'b', e, a, '99' FROM f WHERE a = ':nationkey' AND v = '7'")


def changed(f: Callable[[Facts, DataFrame], Facts], schema: dict | None = None) -> Run:
    """f of the names and nations of all customers, and the nations that are 5; the facts after it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        base = few(spark, d)
        return shown(f(init_facts(base, schema), base.filter("a = ':nationkey' and v.lng = 5")).df)

    return run


def _lng(x: Any) -> Column:
    return to_any(F.lit(x).cast("long"), "long").cast(ANY)


def _set_nation(df: DataFrame, to: int) -> DataFrame:
    return df.withColumn("v", _lng(to)).withColumn("tx", F.col("tx") + 1)


NAME_ID = {":name": {":db/unique": ":db.unique/identity"}}
TAGS = {":tag": {":db/cardinality": ":db.cardinality/many"}}
MANY = {":nationkey": {":db/cardinality": ":db.cardinality/many"}}
FIVE = "a = ':nationkey' AND v = '5'"
plain("tx_add", changed(lambda b, x: b.add(_set_nation(x, 99))), f"WITH {FACTS} SELECT e, a, CASE WHEN {FIVE} THEN '99' ELSE v END AS v FROM f")
plain("tx_retract", changed(lambda b, x: b.retract(x.select("e", "a", "v"))), f"WITH {FACTS} SELECT e, a, v FROM f WHERE NOT ({FIVE})")
plain("tx_retract_attr", changed(lambda b, x: b.retract(x.select("e", "a"))), f"WITH {FACTS} SELECT e, a, v FROM f WHERE NOT ({FIVE})")
plain("tx_many", changed(lambda b, x: b.add(_set_nation(x, 99)), MANY), f"WITH {FACTS} SELECT e, a, v FROM f UNION SELECT e, a, '99' FROM f WHERE {FIVE}")


def tx_cas(b: Facts, x: DataFrame) -> Facts:
    """The nation 5 becomes 50, and who has no rank gets one."""
    none = F.lit(None).cast(ANY)
    return b.cas(x.select("e", "a", F.col("v").alias("old"), _lng(50).alias("new")).unionByName(x.select("e", F.lit(":rank").alias("a"), none.alias("old"), _lng(1).alias("new"))))


plain("tx_cas", changed(tx_cas), f"WITH {FACTS} SELECT e, a, CASE WHEN {FIVE} THEN '50' ELSE v END AS v FROM f UNION ALL SELECT e, ':rank', '1' FROM f WHERE {FIVE}")


def tx_map(b: Facts, x: DataFrame) -> Facts:
    """Maps of known entities: a new nation and two tags for each."""
    tag = lambda t: to_any(F.lit(t), "string").cast(ANY)
    values = F.array(F.struct(F.lit(":nationkey").alias("a"), _lng(77).alias("v")), *[F.struct(F.lit(":tag").alias("a"), tag(t).alias("v")) for t in "xy"])
    return b.upsert(x.select(F.col("e").alias("t"), F.explode(values).alias("m")).select("t", "m.*"))[0]


plain("tx_map", changed(tx_map, TAGS), f"WITH {FACTS} SELECT e, a, CASE WHEN {FIVE} THEN '77' ELSE v END AS v FROM f UNION ALL SELECT e, ':tag', unnest(['x', 'y']) FROM f WHERE {FIVE}")


def tx_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Maps named by tempids: customers of the nation 5, known by name, move to 60; suppliers are new entities."""
    base = few(spark, d)
    c, s = spark.read.parquet(f"{d}/customer.parquet").filter("c_nationkey = 5"), spark.read.parquet(f"{d}/supplier.parquet")
    maps = rows_of(c, -1 - F.col("c_custkey"), name=(F.col("c_name"), "string")).unionByName(rows_of(c, -1 - F.col("c_custkey"), nationkey=(F.lit(60), "long")))
    new = -(10**12) - F.col("s_suppkey")
    maps = maps.unionByName(rows_of(s, new, name=(F.col("s_name"), "string"))).unionByName(rows_of(s, new, nationkey=(F.col("s_nationkey"), "long")))
    return shown(init_facts(base, NAME_ID).upsert(maps.withColumnRenamed("e", "t"))[0].df)


NEW = "n AS (SELECT (SELECT max(c_custkey + 1) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS e, s_name, s_nationkey FROM supplier)"
plain("tx_upsert", tx_upsert, f"WITH {FACTS}, {NEW} SELECT e, a, CASE WHEN {FIVE} THEN '60' ELSE v END AS v FROM f UNION ALL SELECT e, ':name', s_name FROM n UNION ALL SELECT e, ':nationkey', s_nationkey::VARCHAR FROM n")


def orders_of_customers(spark: SparkSession, d: str) -> Facts:
    """Customers with their orders as components, and suppliers that refer to the customer with their number."""
    c, o, s = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders", "supplier"))
    order = F.col("o_orderkey") + 10**10
    rows = rows_of(c, F.col("c_custkey"), name=(F.col("c_name"), "string")).unionByName(rows_of(c, F.col("c_custkey"), nationkey=(F.col("c_nationkey"), "long")))
    rows = rows.unionByName(rows_of(o, F.col("o_custkey"), order=(order, "long"))).unionByName(rows_of(o, order, status=(F.col("o_orderstatus"), "string")))
    rows = rows.unionByName(rows_of(s, F.col("s_suppkey") + 10**11, client=(F.col("s_suppkey"), "long")))
    many = {":db/valueType": ":db.type/ref", ":db/cardinality": ":db.cardinality/many", ":db/isComponent": True}
    return init_facts(rows, {":order": many, ":client": {":db/valueType": ":db.type/ref"}})


ORDERS = """f AS (SELECT c_custkey::BIGINT AS e, ':name' AS a, c_name AS v, c_custkey AS c FROM customer UNION ALL SELECT c_custkey, ':nationkey', c_nationkey::VARCHAR, c_custkey FROM customer
  UNION ALL SELECT o_custkey, ':order', (o_orderkey + 10000000000)::VARCHAR, o_custkey FROM orders UNION ALL SELECT o_orderkey + 10000000000, ':status', o_orderstatus, o_custkey FROM orders
  UNION ALL SELECT s_suppkey + 100000000000, ':client', s_suppkey::VARCHAR, s_suppkey FROM supplier)"""


def tx_retract_entity(spark: SparkSession, d: str) -> DataFrame:
    """Without the customers of the nation 5, their orders, and what refers to them."""
    f = orders_of_customers(spark, d)
    return shown(f.retract(f.df.filter("a = ':nationkey' and v.lng = 5").select("e")).df)


plain("tx_retract_entity", tx_retract_entity, f"WITH {ORDERS} SELECT e, a, v FROM f WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")


def tx_unique(spark: SparkSession, d: str) -> DataFrame:
    """What the check of unique attributes finds, were nations unique: the transaction that adds them is refused with its first row."""
    f = init_facts(few(spark, d), {":nationkey": {":db/unique": ":db.unique/value"}})
    return clashes(f.df, [":nationkey"]).select(F.col("v.lng").alias("v"), "n")


plain("tx_unique", tx_unique, "SELECT c_nationkey::BIGINT AS v, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")


def tx_tuple(spark: SparkSession, d: str) -> DataFrame:
    """The composites that follow as the nation 5 becomes 99, and those of the others, from adding all nations."""
    base = few(spark, d)
    f = init_facts(base.filter("a = ':name'"), {":name+nation": {":db/tupleAttrs": [":name", ":nationkey"]}})
    f = f.add(base.filter("a = ':nationkey'")).add(_set_nation(base.filter("a = ':nationkey' and v.lng = 5"), 99))
    return f.df.filter("a = ':name+nation'").select("e", F.col("v.str").alias("v"))


plain("tx_tuple", tx_tuple, """SELECT c_custkey + 1 AS e, '00000002["' || c_name || '" ' || CASE WHEN c_nationkey = 5 THEN 99 ELSE c_nationkey END || ']' AS v FROM customer""")
LINE = """'{"e":' || e || ',"a":"' || a || '","v":{' || CASE WHEN a = ':name' THEN '"rank":5,"str":"' || v || '"' ELSE '"rank":4,"num":' || v || '.0,"lng":' || v END || '},"tx":536870913}'"""
plain("serializable", lambda s, d: init_facts(few(s, d)).to_lines(), f"WITH {FACTS} SELECT {LINE} AS line FROM f")
plain("from_serializable", lambda s, d: shown(from_lines(init_facts(few(s, d)).to_lines()).df), f"WITH {FACTS} SELECT e, a, v FROM f")

# ---- pull


def pulled(name: str, table: str, pattern: str, select: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        db = tpch_tables(spark, d)
        t = db.table(table)
        return pull_df(db, t.df.select(F.col(t.key).alias("id")), pattern, f"eid:{table}").selectExpr(*select)

    plain(name, run, sql)


pulled("pull_attrs", "customer", "[:customer/c_name :customer/c_acctbal]", ["id", "c_name", "c_acctbal"], "SELECT c_custkey AS id, c_name, c_acctbal FROM customer")
pulled("pull_many", "nation", "[:nation/n_name]", ["id", "n_name"], "SELECT n_nationkey AS id, n_name FROM nation")
pulled("pull_nested", "customer", "[:customer/c_name {:customer/c_nationkey [:nation/n_name {:nation/n_regionkey [:region/r_name]}]}]", ["id", "c_name", "c_nationkey.n_name as n_name", "c_nationkey.n_regionkey.r_name as r_name"], "SELECT c_custkey AS id, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pulled("pull_reverse", "region", "[:region/r_name {:nation/_n_regionkey [:nation/n_name]}]", ["id", "r_name", "transform(n_regionkey, x -> x.n_name) as nations"], "SELECT r_regionkey AS id, r_name, list(n_name ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
pulled("pull_limit", "region", "[{(limit :nation/_n_regionkey 2) [:nation/n_name]}]", ["id", "transform(n_regionkey, x -> x.n_name) as nations"], "SELECT n_regionkey AS id, list(n_name ORDER BY n_nationkey)[1:2] AS nations FROM nation GROUP BY 1")


def pull_multival(spark: SparkSession, d: str) -> DataFrame:
    """An attribute with many values: the names of each region's nations, as facts of the region."""
    rows = rows_of(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_regionkey"), nation=(F.col("n_name"), "string"))
    source = DatomSource.of_frame(spark, rows, {":nation": {":db/cardinality": ":db.cardinality/many"}})
    return pull_df(source, rows.select(F.col("e").alias("id")).distinct(), "[(limit :nation 3)]").select("id", F.col("nation").alias("names"))


plain("pull_multival", pull_multival, "SELECT n_regionkey::BIGINT AS id, list(n_name ORDER BY n_name)[1:3] AS names FROM nation GROUP BY 1")
pulled("pull_default", "documents", '[(default :documents/lang "none") :documents/n_chars]', ["id", "lang", "n_chars"], "SELECT doc_id AS id, coalesce(lang, 'none') AS lang, n_chars FROM documents")
pulled("pull_as", "nation", "[[:nation/n_name :as :label]]", ["id", "label"], "SELECT n_nationkey AS id, n_name AS label FROM nation")
pulled("pull_wildcard", "nation", "[*]", ["id", "n_nationkey", "n_name", "n_regionkey"], "SELECT n_nationkey AS id, n_nationkey, n_name, n_regionkey FROM nation")


def pull_xform(spark: SparkSession, d: str) -> DataFrame:
    db = tpch_tables(spark, d)
    return pull_df(db, db.table("nation").df.select(F.col("n_nationkey").alias("id")), [[Keyword(":nation/n_name"), Keyword(":xform"), F.upper]], "eid:nation").select("id", "n_name")


plain("pull_xform", pull_xform, "SELECT n_nationkey AS id, upper(n_name) AS n_name FROM nation")


def pull_recursion(depth: int | None) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Customers whose superior is the one with half their number, pulled to a depth, as paths of names."""
        c = spark.read.parquet(f"{d}/customer.parquet")
        above = c.filter("c_custkey > 1")
        rows = rows_of(c, F.col("c_custkey"), name=(F.col("c_name"), "string")).unionByName(rows_of(above, F.col("c_custkey"), boss=(F.expr("c_custkey div 2"), "long")))
        f = init_facts(rows, {":boss": {":db/valueType": ":db.type/ref"}})
        met = f.pull_rows(c.select(F.col("c_custkey").cast("long").alias("id")), [":name"], [":boss"], depth)
        names = F.sort_array(F.collect_list(F.struct(F.size("path"), F.col("v.str").alias("name"))))
        return met.groupBy(F.col("root").alias("id")).agg(F.array_join(F.transform(names, lambda x: x["name"]), "/").alias("path"))

    return run


CHAIN = "WITH RECURSIVE t(id, e, n) AS (SELECT c_custkey::BIGINT, c_custkey::BIGINT, 0 FROM customer UNION ALL SELECT id, e // 2, n + 1 FROM t WHERE e > 1)"
plain("pull_recursion_n", pull_recursion(2), f"{CHAIN} SELECT id, string_agg(c_name, '/' ORDER BY n) AS path FROM t JOIN customer ON e = c_custkey WHERE n <= 2 GROUP BY 1")
plain("pull_recursion_inf", pull_recursion(None), f"{CHAIN} SELECT id, string_agg(c_name, '/' ORDER BY n) AS path FROM t JOIN customer ON e = c_custkey GROUP BY 1")


def pull_component(spark: SparkSession, d: str) -> DataFrame:
    """Customers with all their attributes, and those of their components."""
    f = orders_of_customers(spark, d)
    met = f.pull_rows(f.df.filter("a = ':name'").select(F.col("e").alias("id")))
    return met.select("root", "e", "a", F.coalesce("v.str", F.col("v.lng").cast("string")).alias("v"))


plain("pull_component", pull_component, f"WITH {ORDERS} SELECT c::BIGINT AS root, e, a, v FROM f WHERE a != ':client'")


def find_pull(spark: SparkSession, d: str) -> DataFrame:
    df = q_df('[:find (pull ?c [:customer/c_name :customer/c_acctbal]) :where [?c :customer/c_mktsegment "BUILDING"]]', tpch_tables(spark, d), spark=spark)
    return df.select("pull_c.c_name", "pull_c.c_acctbal")


plain("find_pull", find_pull, "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
