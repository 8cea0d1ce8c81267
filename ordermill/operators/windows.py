"""What was a loop over a client's orders, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bridge import Domain
from .joins import with_product


def frequency(d: Domain) -> DataFrame:
    """client_id, frequency: mean whole days between successive orders; clients with two dated orders or more.

    Between two orders of one day no whole day lies, so that orders are aggregated by day first: the window runs over a
    client's days, however many orders these have."""
    x = d.commandes.filter("created_at is not null and client_id is not null")
    x = x.groupBy("client_id", F.to_date("created_at").alias("day")).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count("*").alias("n"))
    before = F.lag("last").over(Window.partitionBy("client_id").orderBy("day"))
    x = x.select("client_id", "n", F.timestamp_diff("DAY", before, F.col("first")).alias("gap")).groupBy("client_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("days"))
    return x.filter("n > 1").select("client_id", F.round(F.col("days") / (F.col("n") - 1), 4).alias("frequency"))


#: What a client's reference order gives to later ones, beside its product's type.
REFERENCE = ("nature_produit", "quantite", "unite", "prix_unitaire", "prix_total", "devise")


def _there(d: Domain, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in d.commandes.columns]


def typical(d: Domain) -> DataFrame:
    """Each client's newest validated order as its typical one: produit_type, nature_produit, quantite, unite."""
    newest, fields = F.struct("created_at", "id"), _there(d, ("nature_produit", "quantite", "unite"))
    x = d.commandes.filter("statut = 'validee' and client_id is not null and created_at is not null")
    x = x.groupBy("client_id").agg(F.max_by(F.struct("produit_id", *fields), newest).alias("t")).select("client_id", "t.*")
    return with_product(Domain(d.clients, d.produits, x)).select("client_id", "produit_type", *fields)


def last_reference(d: Domain) -> DataFrame:
    """The order that fills gaps for a client, with its product's type as type_produit: the validated order last validated,
    else the newest one. An aggregate by client, so that a client with very many orders is combined before the shuffle."""
    c = F.col
    valid, never = (c("statut") == "validee").cast("int"), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    first = F.struct(F.coalesce(valid, F.lit(0)), F.coalesce(F.when(valid == 1, c("validated_at")), never), F.coalesce("created_at", never), "id")
    fields = ("statut", "validated_at", "created_at", "numero_commande", "produit_id", *_there(d, REFERENCE))
    x = d.commandes.filter("client_id is not null").groupBy("client_id").agg(F.max_by(F.struct(c("id").alias("order_id"), *fields), first).alias("r")).select("client_id", "r.*")
    return with_product(Domain(d.clients, d.produits, x)).withColumnRenamed("produit_type", "type_produit")


def ranked_clients(d: Domain, n: int = 10) -> DataFrame:
    """rank, client_id, revenue of the clients with most revenue."""
    x = d.commandes.filter("client_id is not null").groupBy("client_id").agg(F.round(F.sum("prix_total"), 2).alias("revenue")).orderBy(F.desc("revenue"), "client_id").limit(n)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "client_id")))  # n rows


def first_and_last(d: Domain) -> DataFrame:
    return d.commandes.filter("client_id is not null").groupBy("client_id").agg(F.min("created_at").alias("first_order"), F.max("created_at").alias("last_order"))
