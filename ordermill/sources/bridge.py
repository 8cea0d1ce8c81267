"""Domain tables: clients, products and orders, out of the star schema at hand.

Orders keep what the domain is about: nulls in quantities, products, sources and numbers, and dates as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    clients: DataFrame
    produits: DataFrame
    commandes: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("nom"),
        F.when(key % 3 != 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(key % 4 == 0, F.concat(F.lit("+2126"), F.lpad(key.cast("string"), 8, "0"))).alias("telephone"),
    )


def produits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: a handful of types, numbered by name."""
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("type")).distinct()
    return types.select(F.row_number().over(Window.orderBy("type")).cast("long").alias("id"), "type")


def commandes(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """Orders; without `lines` only the columns that need neither order lines nor parts, and no join."""
    key, urgency = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "P", "en_attente").when(F.col("o_orderstatus") == "F", "validee").otherwise("rejetee")
    own = {
        "id": key,
        "client_id": F.col("o_custkey"),
        "numero_commande": F.when(key % 10 != 0, F.concat(F.lit("BC-"), F.lpad(key.cast("string"), 8, "0"))),
        "prix_total": F.col("o_totalprice"),
        "type_papier": F.when(key % 3 == 0, "Kraft Blanchi").when(key % 3 == 1, F.lit("")),
        "unite": F.when(key % 5 != 0, "US"),
        "prix_unitaire": F.when(key % 3 != 0, F.col("o_totalprice") / 4),
        "devise": F.when(key % 7 != 0, F.when(key % 2 == 0, "MAD").otherwise("EUR")),
        "informations_supplementaires": F.when(key % 9 == 0, F.lit("livraison urgente svp")).when(key % 9 == 1, F.lit("")),
        "statut": status,
        "source": F.when(urgency.isin("1", "2"), "whatsapp").when(urgency.isin("3", "4"), "email"),
        "email_subject": F.when(urgency == "1", F.concat(F.lit("Commande URGENTE "), key.cast("string"))).otherwise(F.concat(F.lit("commande "), key.cast("string"))),
        "email_id": F.concat(F.lit("mail-"), key.cast("string")),
        "confiance": 40 + key % 61,
        "created_at": F.col("o_orderdate"),
    }
    orders = read(spark, sf_dir, "orders")
    if not lines:
        return orders.select(*[c.alias(name) for name, c in own.items()])
    size = F.col("p_size")
    grammage = F.when(size % 5 != 0, 40 + 10 * (size % 7)).cast("long")
    own |= {
        "produit_id": F.col("produit_id"),
        "nature_produit": F.col("p_name"),
        "quantite": F.col("quantite"),
        "quantite_livree": F.col("quantite_livree"),
        "reste_a_livrer": F.coalesce("quantite", F.lit(0.0)) - F.coalesce("quantite_livree", F.lit(0.0)),
        "code_article": F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("KB"), grammage.cast("string"), F.lit("L"), size.cast("string"))),
        "grammage": grammage,
        "laize": size.cast("long"),
        "validated_at": F.when(F.col("o_orderstatus") == "F", F.col("shipped")),
    }
    each = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantite"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("quantite_livree"),
        F.min("l_partkey").alias("p_partkey"),
        F.max("l_shipdate").alias("shipped"),
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    x = orders.join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(parts, "p_partkey", "left")
    x = x.join(produits(spark, sf_dir).withColumnRenamed("id", "produit_id"), F.col("p_type") == F.col("type"), "left")
    return x.select(*[own[name].alias(name) for name in COLUMNS])


#: The columns of orders, in their order.
COLUMNS = (
    "id", "client_id", "produit_id", "numero_commande", "nature_produit", "quantite", "quantite_livree", "reste_a_livrer", "prix_total", "code_article", "grammage", "laize", "type_papier", "unite", "prix_unitaire", "devise",
    "informations_supplementaires", "statut", "source", "email_subject", "email_id", "confiance", "created_at", "validated_at",
)


def domain(spark: SparkSession, sf_dir: str, lines: bool = True) -> Domain:
    return Domain(clients(spark, sf_dir), produits(spark, sf_dir), commandes(spark, sf_dir, lines))


#: The same tables as common table expressions, for DuckDB.
BRIDGE_SQL = """
WITH clients AS (
  SELECT c_custkey AS id, c_name AS nom, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email,
    CASE WHEN c_custkey % 4 = 0 THEN '+2126' || lpad(c_custkey::VARCHAR, 8, '0') END AS telephone
  FROM customer),
produits AS (SELECT row_number() OVER (ORDER BY type) AS id, type FROM (SELECT DISTINCT p_type AS type FROM part)),
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS quantite, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS quantite_livree,
    min(l_partkey) AS pk, max(l_shipdate) AS shipped
  FROM lineitem GROUP BY l_orderkey),
commandes AS (
  SELECT o_orderkey AS id, o_custkey AS client_id, p.id AS produit_id,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'BC-' || lpad(o_orderkey::VARCHAR, 8, '0') END AS numero_commande, p_name AS nature_produit,
    quantite, quantite_livree, coalesce(quantite, 0) - coalesce(quantite_livree, 0) AS reste_a_livrer, o_totalprice AS prix_total,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'KB' || (CASE WHEN p_size % 5 <> 0 THEN 40 + 10 * (p_size % 7) END) || 'L' || p_size END AS code_article,
    (CASE WHEN p_size % 5 <> 0 THEN 40 + 10 * (p_size % 7) END)::BIGINT AS grammage, p_size::BIGINT AS laize,
    CASE o_orderkey % 3 WHEN 0 THEN 'Kraft Blanchi' WHEN 1 THEN '' END AS type_papier, CASE WHEN o_orderkey % 5 <> 0 THEN 'US' END AS unite,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 4 END AS prix_unitaire, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'MAD' ELSE 'EUR' END END AS devise,
    CASE o_orderkey % 9 WHEN 0 THEN 'livraison urgente svp' WHEN 1 THEN '' END AS informations_supplementaires,
    CASE o_orderstatus WHEN 'P' THEN 'en_attente' WHEN 'F' THEN 'validee' ELSE 'rejetee' END AS statut,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'whatsapp' WHEN o_orderpriority[1] IN ('3', '4') THEN 'email' END AS source,
    CASE WHEN o_orderpriority[1] = '1' THEN 'Commande URGENTE ' ELSE 'commande ' END || o_orderkey AS email_subject,
    'mail-' || o_orderkey AS email_id, 40 + o_orderkey % 61 AS confiance, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN shipped END AS validated_at
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk LEFT JOIN produits p ON p.type = p_type)
"""
