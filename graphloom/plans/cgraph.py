"""The star-schema tables seen as a code graph: routes, pages, components, endpoints, handlers, repositories, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type, layer, module, path."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = t("nation").select("n_nationkey", "n_name")
    customer = t("customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customer.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    supplier = t("supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    text, lit = lambda c: F.col(c).cast("string"), F.lit
    parts = [
        t("region").select(_id("region", "r_regionkey"), "r_name", lit("route"), lit("ui-route"), lit("shared"), F.concat(lit("front/geo/"), "r_name")),
        nation.select(_id("nation", "n_nationkey"), "n_name", lit("page"), lit("ui-page"), "r_name", F.concat(lit("front/geo/"), "r_name", lit("/"), "n_name")),
        customer.select(_id("customer", "c_custkey"), "c_name", lit("component"), lit("ui-component-logic"), "n_name", F.concat(lit("front/features/"), "n_name", lit("/"), "c_mktsegment", lit("/"), "c_name")),
        orders.select(_id("order", "o_orderkey"), F.concat("o_orderpriority", lit(" "), text("o_orderkey")), lit("endpoint"), lit("api-endpoint"), "n_name", F.concat(lit("api/"), "o_orderstatus", lit("/"), text("o_orderkey"))),
        supplier.select(_id("supplier", "s_suppkey"), "s_name", lit("handler"), lit("application-handler"), "n_name", F.concat(lit("back/handlers/"), "n_name", lit("/"), "s_name")),
        t("part").select(_id("part", "p_partkey"), "p_name", lit("repository"), lit("backend-repository"), "p_brand", F.concat(lit("back/repositories/"), "p_brand", lit("/"), "p_type", lit("/"), text("p_partkey"))),
        t("part").select(_id("table", "p_brand"), "p_brand", lit("table"), lit("database-table"), F.col("p_brand").alias("m"), lit(None).cast("string")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("id", "label", "type", "layer", "module", "path")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, dst, type, confidence; id is src::type::dst."""
    t = lambda n: table(spark, sf_dir, n)
    lit = F.lit
    heavy = t("lineitem").filter("l_quantity >= 46")
    parts = [
        t("nation").select(_id("region", "n_regionkey"), _id("nation", "n_nationkey"), lit("imports"), lit("high")),
        t("customer").select(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), lit("imports"), lit("high")),
        t("orders").filter("o_orderstatus <> 'P'").select(_id("customer", "o_custkey"), _id("order", "o_orderkey"), lit("calls-api"), lit("medium")),
        heavy.select(_id("order", "l_orderkey"), _id("supplier", "l_suppkey"), lit("handled-by"), lit("high")).distinct(),
        heavy.select(_id("supplier", "l_suppkey"), _id("part", "l_partkey"), lit("depends-on"), lit("high")).distinct(),
        t("part").select(_id("part", "p_partkey"), _id("table", "p_brand"), lit("queries-table"), lit("medium")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.toDF("src", "dst", "type", "confidence")
    return out.select(F.concat_ws("::", "src", "type", "dst").alias("id"), "src", "dst", "type", "confidence")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rule_id, severity, node_id, path, line: two rules over parts, as findings on repositories."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("back/repositories/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"))
    one = lambda rule, severity, where: p.filter(where).select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), _id("part", "p_partkey").alias("node_id"), path.alias("path"), F.col("p_size").alias("line"))
    both = one("size.large", "warning", "p_size > 45").union(one("type.economy", "error", "p_type = 'ECONOMY' and p_size > 25"))
    return both.select(F.concat_ws(":", "rule_id", "node_id").alias("id"), "*")


NODES_SQL = """SELECT concat('region:', r_regionkey) AS id, r_name AS label, 'route' AS type, 'ui-route' AS layer, 'shared' AS module, concat('front/geo/', r_name) AS path FROM region
UNION ALL SELECT concat('nation:', n_nationkey), n_name, 'page', 'ui-page', r_name, concat('front/geo/', r_name, '/', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('customer:', c_custkey), c_name, 'component', 'ui-component-logic', n_name, concat('front/features/', n_name, '/', c_mktsegment, '/', c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('order:', o_orderkey), concat(o_orderpriority, ' ', o_orderkey), 'endpoint', 'api-endpoint', n_name, concat('api/', o_orderstatus, '/', o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('supplier:', s_suppkey), s_name, 'handler', 'application-handler', n_name, concat('back/handlers/', n_name, '/', s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('part:', p_partkey), p_name, 'repository', 'backend-repository', p_brand, concat('back/repositories/', p_brand, '/', p_type, '/', p_partkey) FROM part
UNION ALL SELECT DISTINCT concat('table:', p_brand), p_brand, 'table', 'database-table', p_brand, CAST(NULL AS VARCHAR) FROM part"""

EDGES_SQL = """SELECT concat(src, '::', type, '::', dst) AS id, src, dst, type, confidence FROM (
SELECT concat('region:', n_regionkey) AS src, concat('nation:', n_nationkey) AS dst, 'imports' AS type, 'high' AS confidence FROM nation
UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey), 'imports', 'high' FROM customer
UNION ALL SELECT concat('customer:', o_custkey), concat('order:', o_orderkey), 'calls-api', 'medium' FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT DISTINCT concat('order:', l_orderkey), concat('supplier:', l_suppkey), 'handled-by', 'high' FROM lineitem WHERE l_quantity >= 46
UNION ALL SELECT DISTINCT concat('supplier:', l_suppkey), concat('part:', l_partkey), 'depends-on', 'high' FROM lineitem WHERE l_quantity >= 46
UNION ALL SELECT concat('part:', p_partkey), concat('table:', p_brand), 'queries-table', 'medium' FROM part) x"""

FINDINGS_SQL = """SELECT concat(rule_id, ':', node_id) AS id, * FROM (
SELECT 'size.large' AS rule_id, 'warning' AS severity, concat('part:', p_partkey) AS node_id, concat('back/repositories/', p_brand, '/', p_type, '/', p_partkey) AS path, p_size AS line FROM part WHERE p_size > 45
UNION ALL SELECT 'type.economy', 'error', concat('part:', p_partkey), concat('back/repositories/', p_brand, '/', p_type, '/', p_partkey), p_size FROM part WHERE p_type = 'ECONOMY' AND p_size > 25) f"""

GRAPH_SQL = f"n AS ({NODES_SQL}), e AS ({EDGES_SQL}), fi AS ({FINDINGS_SQL})"
