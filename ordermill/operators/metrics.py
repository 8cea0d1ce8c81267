"""Counts, sums, rankings, trends and segments. Many counts over one table are one conditional aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.clock import Clock
from ..functions.text import blank
from ..sources.bridge import Domain
from .joins import with_client, with_product

#: Orders from which a client is loyal, or regular.
LOYAL, REGULAR = 5, 2


def is_status(name: str) -> Column:
    return F.col("statut") == name


def channel() -> Column:
    """Orders without a source came by mail."""
    return F.coalesce("source", F.lit("email"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage to one decimal or none, half to even; 0 where there is nothing."""
    exact = part / whole * F.lit(100.0)
    return F.when(whole > 0, numbers.rounded(exact) if digits else numbers.whole(exact)).otherwise(0.0)


def stats(d: Domain) -> DataFrame:
    """Order counts by status and channel, and the number of clients."""
    whatsapp, mail = channel() == "whatsapp", channel() == "email"
    orders = d.commandes.agg(
        F.count("*").alias("total_orders"),
        count_where(is_status("en_attente")).alias("pending_orders"),
        count_where(is_status("validee")).alias("validated_orders"),
        count_where(is_status("rejetee")).alias("rejected_orders"),
        *[count_where(where & is_status(s) if s else where).alias(f"{name}_{label}") for name, where in (("whatsapp", whatsapp), ("email", mail)) for s, label in (("", "orders"), ("en_attente", "pending"), ("validee", "validated"))],
    )
    people = d.clients.agg(F.count("*").alias("total_clients"))
    return orders.withColumn("_", F.lit(1)).join(F.broadcast(people.withColumn("_", F.lit(1))), "_").drop("_")  # one row each


def clients_with_orders(d: Domain) -> DataFrame:
    """Every client with its orders counted and its last order, those without orders too."""
    x = d.commandes.groupBy("client_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_order"))
    x = d.clients.join(x, F.col("id") == F.col("client_id"), "left")
    return x.select("id", "nom", "email", "telephone", F.coalesce("n", F.lit(0)).alias("order_count"), "last_order").orderBy("nom", "id")


def by_client(d: Domain) -> DataFrame:
    return d.commandes.groupBy("client_id").agg(F.count("*").alias("order_count"), F.sum("quantite").alias("total_quantity"), F.sum("prix_total").alias("total_spent"))


def top_clients(d: Domain, n: int = 5) -> DataFrame:
    x = by_client(d).join(d.clients.select(F.col("id").alias("client_id"), "nom"), "client_id")
    return x.orderBy(F.desc("order_count"), F.desc_nulls_last("total_quantity"), "client_id").limit(n).select("client_id", "nom", "order_count", F.round("total_quantity", 2).alias("total_quantity"))


def top_products(d: Domain, n: int = 5) -> DataFrame:
    x = d.commandes.groupBy("produit_id").agg(F.count("*").alias("order_count")).join(d.produits.select(F.col("id").alias("produit_id"), "type"), "produit_id")
    return x.orderBy(F.desc("order_count"), "produit_id").limit(n).select("type", "order_count")


def sum_and_mean(d: Domain, column: str, total: str, mean: str) -> DataFrame:
    """Sum and mean of a column, 0 if there is no value."""
    c = F.col(column)
    return d.commandes.agg(F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(total), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(mean))


def orders_by_product(d: Domain) -> DataFrame:
    """Orders and quantities by product, the unknown product too: aggregated by id first, then named."""
    x = d.commandes.groupBy("produit_id").agg(F.count("*").alias("order_count"), F.round(F.sum("quantite"), 2).alias("total_quantity"))
    x = x.join(d.produits.select(F.col("id").alias("produit_id"), F.col("type").alias("produit_type")), "produit_id", "left")
    return x.select("produit_type", "order_count", "total_quantity").orderBy(F.desc("order_count"), F.asc_nulls_first("produit_type"))


def by_status(d: Domain) -> DataFrame:
    return d.commandes.groupBy("statut").agg(F.count("*").alias("order_count"))


def top_clients_by_orders(d: Domain, n: int = 10) -> DataFrame:
    """The clients with most orders and what they spent; orders without a client count as one client."""
    x = by_client(d).join(d.clients.select(F.col("id").alias("client_id"), "nom"), "client_id", "left")
    return x.orderBy(F.desc("order_count"), F.asc_nulls_first("client_id")).limit(n).select("client_id", "nom", "order_count", F.round("total_spent", 2).alias("total_spent"))


def daily_counts(d: Domain, clock: Clock, days: int = 30) -> DataFrame:
    """Orders a day over the last so many times 24 hours."""
    x = d.commandes.filter(F.col("created_at") >= clock.exactly_days_ago(days))
    return x.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("order_count")).orderBy("day")


def daily_volume(d: Domain, clock: Clock, days: int = 7) -> DataFrame:
    x = d.commandes.filter(F.col("created_at") >= clock.exactly_days_ago(days))
    return x.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("order_count"), F.round(F.sum("quantite"), 2).alias("total_quantity")).orderBy("day")


def monthly(d: Domain, months: int = 12, newest_first: bool = True) -> DataFrame:
    """Orders and revenue of the newest months."""
    x = d.commandes.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("order_count"), F.round(F.sum("prix_total"), 2).alias("revenue"))
    x = x.orderBy(F.desc("month")).limit(months)
    return x if newest_first else x.orderBy("month")


def trend(d: Domain, clock: Clock, days: int = 7) -> DataFrame:
    """Orders a day from midnight so many days ago, which is up to one calendar day more."""
    x = d.commandes.filter(F.col("created_at") >= clock.days_ago(days).cast("timestamp_ntz"))
    return x.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("order_count")).orderBy("day")


def trend_filled(d: Domain, clock: Clock, days: int = 7) -> DataFrame:
    """Orders of each of the last so many days, 0 where there are none."""
    spine = d.commandes.sparkSession.range(1).select(F.explode(F.sequence(clock.days_ago(days - 1), clock.today())).alias("day"))
    x = spine.join(F.broadcast(trend(d, clock, days)), "day", "left")  # a row a day
    return x.select("day", F.date_format("day", "dd/MM").alias("label"), F.coalesce("order_count", F.lit(0)).alias("order_count")).orderBy("day")


def channel_split(d: Domain) -> DataFrame:
    return d.commandes.agg(count_where(channel() == "whatsapp").alias("whatsapp"), count_where(channel() == "email").alias("email"))


def channel_validation(d: Domain) -> DataFrame:
    """Orders and validated orders by channel, orders without a source with those by mail."""
    x = d.commandes.groupBy(channel().alias("channel")).agg(F.count("*").alias("total"), count_where(is_status("validee")).alias("validated"))
    rate = share(F.col("validated"), F.col("total"))
    return x.withColumn("rate", rate).withColumn("trend", F.when(rate >= 70, "Bon").when(rate >= 50, "Moyen").otherwise("À améliorer"))


def processing_hours(d: Domain) -> DataFrame:
    """Mean hours from order to validation, by exact seconds, 0 if there is none."""
    hours = F.timestamp_diff("SECOND", F.col("created_at"), F.col("validated_at")) / F.lit(3600.0)
    return d.commandes.filter(is_status("validee") & F.col("validated_at").isNotNull()).agg(F.round(F.coalesce(F.avg(hours), F.lit(0.0)), 4).alias("avg_hours"))


def product_revenue(d: Domain) -> DataFrame:
    x = with_product(Domain(d.clients, d.produits, d.commandes.groupBy("produit_id").agg(F.count("*").alias("order_count"), F.sum("quantite").alias("q"), F.sum("prix_total").alias("r"))))
    return x.select("produit_type", "order_count", F.round("q", 2).alias("total_quantity"), F.round("r", 2).alias("revenue")).orderBy(F.desc_nulls_last("revenue"), "produit_type")


def segments(d: Domain, loyal: int = LOYAL, regular: int = REGULAR) -> DataFrame:
    """Clients by how often they order; orders without a client count as one client."""
    x = d.commandes.groupBy("client_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") >= loyal, "Fidèles").when(F.col("n") >= regular, "Réguliers").otherwise("Nouveaux")
    return x.groupBy(kind.alias("segment")).agg(F.count("*").alias("clients"))


def kpis(d: Domain) -> DataFrame:
    """Shares of validated, rejected and WhatsApp orders, and the main channel's."""
    x = d.commandes.agg(F.count("*").alias("total"), count_where(is_status("validee")).alias("v"), count_where(is_status("rejetee")).alias("r"), count_where(channel() == "whatsapp").alias("w"))
    c = F.col
    x = x.select("total", share(c("v"), c("total")).alias("validation_rate"), share(c("r"), c("total")).alias("rejection_rate"), share(c("w"), c("total")).alias("whatsapp_rate"))
    return x.withColumn("main_channel_share", F.greatest(c("whatsapp_rate"), 100 - c("whatsapp_rate")))


def client_share(d: Domain, n: int = 10) -> DataFrame:
    """The top clients with rank, mean basket and share of the revenue of all orders."""
    total = d.commandes.agg(F.coalesce(F.nullif(F.sum("prix_total"), F.lit(0.0)), F.lit(1.0)).alias("all_revenue"))  # one row
    top = by_client(d).orderBy(F.desc("order_count"), F.asc_nulls_first("client_id")).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("order_count"), F.asc_nulls_first("client_id"))))  # n rows
    x = top.withColumn("_", F.lit(1)).join(F.broadcast(total.withColumn("_", F.lit(1))), "_")
    return x.select("rank", "client_id", "order_count", F.round(F.coalesce("total_spent", F.lit(0.0)) / F.col("order_count"), 2).alias("avg_basket"), F.round(F.coalesce("total_spent", F.lit(0.0)) * 100 / F.col("all_revenue"), 4).alias("share_pct"))


def erp_stats(d: Domain) -> DataFrame:
    """How far orders are coded for the ERP: a code that is not blank, and all three of its fields present."""
    coded = ~blank(F.col("code_article"))
    complete = F.col("code_article").isNotNull() & F.col("grammage").isNotNull() & F.col("laize").isNotNull()
    x = d.commandes.agg(
        F.count("*").alias("total"), count_where(coded).alias("with_code"), count_where(~coded).alias("without_code"), count_where(is_status("validee")).alias("validated"), count_where(complete).alias("complete")
    )
    return x.withColumn("completion_rate", share(F.col("with_code"), F.col("total")))


def top_codes(d: Domain, n: int = 10) -> DataFrame:
    x = d.commandes.filter(~blank(F.col("code_article"))).groupBy("code_article").agg(F.count("*").alias("order_count"))
    return x.orderBy(F.desc("order_count"), "code_article").limit(n)


def channel_page(d: Domain, clock: Clock) -> DataFrame:
    """Counts of the WhatsApp page: all, by status, today, in seven days, in the month, and the validated share."""
    day = F.to_date("created_at")
    x = d.commandes.filter((F.col("source") == "whatsapp") | F.col("email_subject").ilike("WhatsApp%")).agg(
        F.count("*").alias("total"),
        count_where(is_status("en_attente")).alias("pending"),
        count_where(is_status("validee")).alias("validated"),
        count_where(day == clock.today()).alias("today"),
        count_where(day >= clock.days_ago(7)).alias("week"),
        count_where(day >= clock.month_start()).alias("month"),
    )
    return x.withColumn("validation_rate", share(F.col("validated"), F.col("total"), 0))


def mean_quantity(d: Domain) -> DataFrame:
    """Mean quantity by client without nulls and zeros, 0 if there is none."""
    return d.commandes.groupBy("client_id").agg(F.round(F.coalesce(F.avg(F.nullif(F.col("quantite"), F.lit(0.0))), F.lit(0.0)), 4).alias("average_quantity"))


def unit_price(d: Domain) -> DataFrame:
    """The mean of the orders' unit prices, where there is a quantity."""
    return d.commandes.filter(F.col("prix_total").isNotNull() & (F.col("quantite") > 0)).agg(F.round(F.avg(F.try_divide("prix_total", "quantite")), 4).alias("avg_unit_price"))


def quantity_baseline(d: Domain) -> DataFrame:
    return d.commandes.agg(F.round(F.avg("quantite"), 4).alias("avg_quantity"), F.max("quantite").alias("max_quantity"))


def newest_id(d: Domain) -> DataFrame:
    return d.commandes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def table_counts(d: Domain) -> DataFrame:
    counted = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, x in (("clients", d.clients), ("produits", d.produits), ("commandes", d.commandes))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def channel_clients(d: Domain, n: int = 5) -> DataFrame:
    """The clients with most WhatsApp orders."""
    x = d.commandes.filter("source = 'whatsapp'").groupBy("client_id").agg(F.count("*").alias("order_count")).join(d.clients.select(F.col("id").alias("client_id"), "nom"), "client_id")
    return x.orderBy(F.desc("order_count"), "client_id").limit(n).select("client_id", "nom", "order_count")


def recent(d: Domain, n: int = 20) -> DataFrame:
    """The newest orders with their client, newest first."""
    x = d.commandes.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)
    x = with_client(Domain(d.clients, d.produits, x))
    return x.select("id", "client_nom", "statut", "created_at").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def unread(notifications: DataFrame) -> DataFrame:
    """How many notifications (is_read) have not been read."""
    return notifications.agg(count_where(~F.coalesce("is_read", F.lit(False))).alias("unread"))


def dashboard_rates(d: Domain) -> DataFrame:
    """Validated and coded orders as whole percentages."""
    x = d.commandes.agg(F.count("*").alias("total"), count_where(is_status("validee")).alias("v"), count_where(~blank(F.col("code_article"))).alias("coded"))
    return x.select("total", *[share(F.col(c), F.col("total"), 0).cast("int").alias(name) for c, name in (("v", "validated_pct"), ("coded", "coded_pct"))])


def revenue_in_thousands(d: Domain) -> DataFrame:
    """Revenue of each month, in thousands to one decimal."""
    x = d.commandes.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.round(F.sum("prix_total"), 2).alias("r"))
    return x.select("month", numbers.rounded(numbers.thousands_of(F.col("r"))).alias("revenue_k"))


def any_table_counts(spark: SparkSession, names: list[str] | None = None, database: str | None = None) -> DataFrame:
    """table_name, n of every table of the session's catalogue, or of those named."""
    found = names or sorted(t.name for t in spark.catalog.listTables(database))
    out = None
    for name in found:
        one = spark.table(f"{database}.{name}" if database else name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "table_name string, n long") if out is None else out
