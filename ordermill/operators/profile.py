"""Client profiles, predictions, anomalies and insights, for all clients in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..sources.bridge import Domain
from . import metrics, windows

#: Spending tiers, and factors of an anomaly.
HIGH_VALUE, MEDIUM_VALUE = 10000, 1000
MANY_TIMES, FEW_TIMES = 3.0, 0.3


def favourites(d: Domain, n: int | None = None) -> DataFrame:
    """client_id, rank, produit_id, order_count: products by count, then by the newest order."""
    x = d.commandes.filter("client_id is not null and produit_id is not null").groupBy("client_id", "produit_id").agg(F.count("*").alias("order_count"), F.max(F.struct("created_at", "id")).alias("newest"))
    rank = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("order_count"), F.desc("newest")))
    x = x.withColumn("rank", rank).drop("newest")
    return x.filter(F.col("rank") <= n) if n else x


def profiles(d: Domain) -> DataFrame:
    """One row a client with orders: counts, dates, mean quantity, spending, frequency and typical order."""
    spent = d.commandes.filter("client_id is not null").groupBy("client_id").agg(
        F.count("*").alias("total_orders"),
        F.min("created_at").alias("first_order"),
        F.max("created_at").alias("last_order"),
        F.round(F.coalesce(F.avg(F.nullif(F.col("quantite"), F.lit(0.0))), F.lit(0.0)), 4).alias("average_quantity"),
        F.round(F.coalesce(F.sum("prix_total"), F.lit(0.0)), 2).alias("total_spent"),
    )
    usual = windows.typical(d).select("client_id", F.col("produit_type").alias("typical_product"), F.col("quantite").alias("typical_quantity"))
    return spent.join(windows.frequency(d), "client_id", "left").join(usual, "client_id", "left")


def client_value(spent, high: float = HIGH_VALUE, medium: float = MEDIUM_VALUE):
    return F.when(spent > high, "high").when(spent > medium, "medium").otherwise("low")


def predictions(d: Domain, high: float = HIGH_VALUE, medium: float = MEDIUM_VALUE) -> DataFrame:
    """Next order in whole days, quantity, likely products and value of each client with orders."""
    x = profiles(d)
    likely = favourites(d, 3).join(d.produits.select(F.col("id").alias("produit_id"), "type"), "produit_id")
    likely = likely.groupBy("client_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "type"))), lambda s: s["type"]), ", ").alias("likely_products"))  # three at most
    days = F.nullif(F.col("frequency"), F.lit(0.0)).cast("long")
    x = x.join(likely, "client_id", "left")
    return x.select("client_id", days.alias("predicted_next_order_days"), F.col("average_quantity").alias("predicted_quantity"), F.coalesce("likely_products", F.lit("")).alias("likely_products"), client_value(F.col("total_spent"), high, medium).alias("client_value"))


def anomalies(d: Domain, orders: DataFrame | None = None) -> DataFrame:
    """order_id, type: orders far from the mean quantity or from the mean unit price of all orders."""
    base = d.commandes.agg(F.avg("quantite").alias("mean_q"), F.avg(F.when(F.col("prix_total").isNotNull() & (F.col("quantite") > 0), F.try_divide("prix_total", "quantite"))).alias("mean_p"))
    x = (orders if orders is not None else d.commandes).withColumn("_", F.lit(1)).join(F.broadcast(base.withColumn("_", F.lit(1))), "_")  # one row
    price = F.try_divide("prix_total", "quantite")
    known = (F.col("prix_total") != 0) & (F.col("quantite") != 0)
    found = F.array(
        F.when((F.col("quantite") != 0) & (F.col("quantite") > MANY_TIMES * F.col("mean_q")), F.lit("quantity_anomaly")),
        F.when(known & ((price < FEW_TIMES * F.col("mean_p")) | (price > MANY_TIMES * F.col("mean_p"))), F.lit("price_anomaly")),
    )
    return x.select(F.col("id").alias("order_id"), F.explode(F.array_compact(found)).alias("type"))


def insights(d: Domain) -> DataFrame:
    """Findings from the KPIs: validation, main channel, backlog and concentration on one client."""
    top = metrics.top_clients_by_orders(d, 1).select(F.col("total_spent").alias("top_spent"))
    money = d.commandes.agg(F.coalesce(F.sum("prix_total"), F.lit(0.0)).alias("revenue"), metrics.count_where(metrics.is_status("en_attente")).alias("pending"))
    one = lambda x: x.withColumn("_", F.lit(1))  # noqa: E731  each is one row
    x = one(metrics.kpis(d)).join(F.broadcast(one(money)), "_").join(F.broadcast(one(top)), "_", "left")
    rate, share = F.col("validation_rate"), F.when(F.col("revenue") > 0, F.coalesce("top_spent", F.lit(0.0)) * 100 / F.col("revenue")).otherwise(0.0)
    found = F.array(
        F.when(rate >= 80, F.lit("validation_excellent")).when(rate >= 60, "validation_moyen").otherwise("validation_faible"),
        F.when(F.col("whatsapp_rate") > 50, F.lit("whatsapp_dominant")),
        F.when(F.col("pending") > 5, F.lit("commandes_en_attente")),
        F.when(share > 30, F.lit("concentration_client")),
    )
    return x.select(F.explode(F.array_compact(found)).alias("insight"))


def client_buckets(d: Domain, search: str = "", bucket: str = "", source: str = "") -> DataFrame:
    """Clients whose name, mail or phone holds a text, with an order count in a bucket; 5 and 10 lie in two buckets.

    By source: whatsapp has a phone; email has none, or an address beside it."""
    x, low = metrics.clients_with_orders(d), search.lower().strip()
    holds = F.lit(False)
    for c in ("nom", "email", "telephone"):
        holds = holds | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low))
    limits = {"0": (0, 0), "1-5": (1, 5), "5-10": (5, 10), "10+": (10, None)}
    if low:
        x = x.filter(holds)
    if bucket:
        least, most = limits[bucket]
        x = x.filter((F.col("order_count") >= least) & (F.col("order_count") <= most if most is not None else F.lit(True)))
    phone = ~blank(F.col("telephone"))
    if source == "whatsapp":
        x = x.filter(phone)
    elif source == "email":
        x = x.filter(~phone | F.contains(F.coalesce("email", F.lit("")), F.lit("@")))
    return x


def client_preferences(d: Domain, pattern: str) -> DataFrame:
    """Profiles of the clients whose name holds a text in any case, each by itself."""
    named = d.clients.filter(F.contains(F.lower("nom"), F.lit(pattern.lower()))).select(F.col("id").alias("client_id"), "nom")
    own = Domain(d.clients, d.produits, d.commandes.join(named.select("client_id"), "client_id", "left_semi"))
    return named.join(profiles(own), "client_id")
