"""Alert rules over pending orders, in one scan: an order has a row for each rule that it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import Clock
from ..sources.bridge import Domain
from .joins import client_order_counts

#: The rules' thresholds.
HIGH_QUANTITY, OLD_HOURS, SUSPICIOUS_QUANTITY, NEW_CLIENT, LOW_CONFIDENCE = 10000, 24, 5000, 1, 60


def alerts(d: Domain, clock: Clock, high: float = HIGH_QUANTITY, hours: float = OLD_HOURS, suspicious: float = SUSPICIOUS_QUANTITY, new: int = NEW_CLIENT, low: int = LOW_CONFIDENCE) -> DataFrame:
    """type, severity, message, order_id. Missing clients and numbers print as None and N/A."""
    x = client_order_counts(d.commandes).filter("statut = 'en_attente'")
    x = x.join(d.clients.select(F.col("id").alias("client_id"), "nom"), "client_id", "left")
    who, quantity = F.coalesce("nom", F.lit("None")), F.col("quantite").cast("string")
    number = F.coalesce(F.nullif(F.col("numero_commande"), F.lit("")), F.lit("N/A"))
    age = clock.hours_since(F.col("created_at"))
    urgent = F.coalesce(F.col("email_subject").ilike("%urgent%"), F.lit(False))
    if "informations_supplementaires" in d.commandes.columns:
        urgent = urgent | F.coalesce(F.col("informations_supplementaires").ilike("%urgent%"), F.lit(False))

    def rule(condition: Column, kind: str, severity: str, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), text.alias("message")))

    rules = F.array(
        rule(urgent, "urgent", "high", "Commande urgente en attente: ", number, " - ", who),
        rule(F.col("quantite") > high, "high_quantity", "medium", "Commande avec grande quantité (", quantity, "): ", who),
        rule(age > hours, "pending_too_long", "medium", "Commande en attente depuis ", age.cast("long").cast("string"), "h: ", who),
        rule((F.col("quantite") > suspicious) & (F.col("client_orders") <= new), "suspicious", "high", "⚠️ Nouveau client avec grande commande: ", who, " (", quantity, " unités)"),
        rule(F.col("confiance") < low, "low_confidence", "medium", "Commande avec faible confiance (", F.col("confiance").cast("string"), "%): ", who),
    )
    return x.select(F.col("id").alias("order_id"), F.explode(F.array_compact(rules)).alias("a")).select("a.type", "a.severity", "a.message", "order_id")


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("alerts"))
