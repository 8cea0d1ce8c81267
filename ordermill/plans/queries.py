"""Queries by name: each takes (spark, sf_dir) and returns a DataFrame.

Thresholds are scaled to the data at hand; the operators' defaults are the real ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, numbers
from ..functions import text as T
from ..functions.clock import Clock, day_shown, iso_time, minute_shown, month_day_shown
from ..operators import alerts, export, inbox, ingest, joins, metrics, profile, windows
from ..session import own_folder
from ..sources.bridge import Domain, domain, read
from ..streaming import feeds

CLOCK = Clock()
HIGH, SUSPICIOUS, NEW, OLD = 200, 100, 3, 24
Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[Domain], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(domain(spark, sf_dir))


def _orders(f: Callable[[Domain], DataFrame]) -> Query:
    """A query that needs neither order lines nor parts."""
    return lambda spark, sf_dir: f(domain(spark, sf_dir, lines=False))


def _text(d: Domain) -> DataFrame:
    """Descriptions of articles, from the orders' fields."""
    paper = F.when(F.col("id") % 3 == 0, "kraft blanchi").when(F.col("id") % 3 == 1, "Kraft écru mondi").otherwise("sachet")
    width = F.coalesce("laize", F.lit(25)).cast("string")
    return d.commandes.select("id", F.concat(F.lit("Sachets "), paper, F.lit(" "), F.coalesce("grammage", F.lit(90)).cast("string"), F.lit("g laize "), width).alias("description"), "grammage", "laize", paper.alias("paper"))


def incoming(d: Domain) -> DataFrame:
    """A batch of orders, one for each there is: some known by number or mail, some repeated, some new; of known and
    unknown senders."""
    key = F.col("id")
    again = (key % 500).cast("string")
    return d.commandes.select(
        key.alias("row"),
        F.when(key % 2 == 0, F.col("numero_commande")).otherwise(F.concat(F.lit("NEW-"), again)).alias("numero_commande"),
        F.when(key % 3 == 0, F.col("email_id")).otherwise(F.concat(F.lit("new-"), again)).alias("email_id"),
        F.lit("Standard").alias("type_produit"),
        F.when(key % 4 == 3, F.concat(F.lit("Société "), (key % 7).cast("string"))).when(key % 4 == 2, F.lit(" ")).alias("entreprise_cliente"),
        F.when(key % 4 != 1, F.concat(F.lit("s"), again, F.lit("@example.com"))).alias("email_from"),
        F.when(key % 4 == 1, F.concat(F.lit("whatsapp:+2126"), F.lpad((key % 500 * 4).cast("string"), 8, "0"))).alias("whatsapp_from"),
        "quantite",
        "quantite_livree",
        "devise",
    )


def _requests(d: Domain) -> DataFrame:
    c = F.col
    return d.clients.select(
        c("id").alias("row"),
        F.when(c("id") % 4 == 0, F.upper("nom")).when(c("id") % 4 == 1, F.concat(F.lit("Client WhatsApp "), c("id").cast("string"))).when(c("id") % 4 == 2, F.concat(F.lit("Neuf "), (c("id") % 50).cast("string"))).alias("nom"),
        F.when(c("id") % 5 == 0, c("email")).alias("email"),
        F.when(c("id") % 4 == 1, F.concat(F.lit("+2126"), F.lpad((c("id") + 3).cast("string"), 8, "0"))).alias("telephone"),
    )


def _searches(d: Domain) -> DataFrame:
    return d.clients.select(F.col("id").alias("search_id"), F.concat(F.lit("CLIENT. "), F.substring("nom", -9, 9), F.lit("-été")).alias("search"))


def _named(d: Domain) -> Domain:
    """Clients with names of two words, so that word overlap means something."""
    return Domain(d.clients.withColumn("nom", F.concat(F.lit("Client "), F.substring("nom", -9, 9))), d.produits, d.commandes)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("image/jpeg", "audio/ogg; codecs=opus", "video/mpeg", "application/pdf", "text/vcard", "application/vnd.ms-word.document")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.lit("bonjour")).alias("body"), (F.col("event_id") % 3).cast("int").alias("n_media"), kinds.alias("media_type"))


def _status_changes(d: Domain) -> DataFrame:
    """Each order with the status it is to get, or null; some twice."""
    key = F.col("id")
    to = F.when(key % 11 == 0, F.when(key % 2 == 0, "validee").otherwise("rejetee"))
    x = d.commandes.select("id", to.alias("new_statut"), CLOCK.now().alias("at"), F.when(key % 33 == 0, F.lit("prix")).otherwise("stock").alias("motif"), F.lit("chef").alias("validated_by"), key.alias("row"))
    again = d.commandes.select("id", F.when(key % 22 == 0, F.lit("rejetee")).alias("new_statut"), CLOCK.now().alias("at"), F.lit("retrait").alias("motif"), F.lit("chef").alias("validated_by"), (key - 1).alias("row"))
    return x.unionByName(again)


def _uncoded(d: Domain) -> Domain:
    """Orders of which some have nothing but words to make a code of."""
    key, words = F.col("id"), F.col("id") % 3 == 2
    said = F.concat(F.lit("Sachets "), F.when(key % 2 == 0, "kraft blanchi ").otherwise("papier "), (40 + key % 7 * 10).cast("string"), F.lit("g laize "), (key % 50).cast("string"), F.when(key % 4 == 0, " mondi").otherwise(""))
    x = d.commandes.withColumn("nature_produit", F.when(words & (key % 5 != 0), said).when(~words, F.col("nature_produit")))
    for name in ("type_papier", "grammage", "laize"):
        x = x.withColumn(name, F.when(~words, F.col(name)))
    return Domain(d.clients, d.produits, x)


def _extracted(d: Domain) -> DataFrame:
    key, blank_text = F.col("id"), F.lit("")
    return d.commandes.select(
        key.alias("row"), "client_id", F.when(key % 3 == 0, F.lit("Sacs")).alias("type_produit"), F.when(key % 2 == 0, blank_text).otherwise(F.col("nature_produit")).alias("nature_produit"),
        F.when(key % 4 == 0, F.lit(0.0)).otherwise(F.col("quantite")).alias("quantite"), F.when(key % 3 == 1, "KG").when(key % 3 == 2, blank_text).alias("unite"),
        F.when(key % 2 == 0, F.col("prix_unitaire")).alias("prix_unitaire"), F.when(key % 5 != 0, F.col("prix_total")).alias("prix_total"), F.when(key % 4 == 1, F.col("devise")).alias("devise"),
        F.when(key % 3 == 0, F.lit("vite")).alias("informations_supplementaires"), "confiance",
    )


def _backups(d: Domain) -> DataFrame:
    """A backup for each client, no two of one minute."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(978307200) + F.col("id") * 60), "yyyyMMdd_HHmmss")
    return d.clients.select(F.concat(F.lit("backup_"), stamp, F.when(F.col("id") % 3 == 0, ".db.gz").otherwise(".db")).alias("filename"), (F.col("id") * 70000).alias("size"))


def _fuzzy(d: Domain) -> DataFrame:
    return joins.fuzzy_match(_searches(d), _named(d).clients).select("search_id", "client_id", "nom", F.round("score", 6).alias("score"))


def _filled(d: Domain) -> DataFrame:
    x = ingest.fill_from_history(_extracted(d), windows.last_reference(d))
    return x.select("row", *ingest.FILLABLE, "informations_supplementaires", F.array_join("history_fields", ",").alias("history_fields"), "history_source_order", F.col("confiance").cast("long").alias("confiance"))


def _suggested(d: Domain) -> DataFrame:
    x = _extracted(d).select("row", "client_id", F.col("type_produit").alias("produit_type"), "nature_produit", "quantite", "unite")
    return inbox.suggest_reorder(x, windows.typical(d)).drop("client_id")


def _expired(backups: DataFrame) -> DataFrame:
    return export.expired(export.listed(backups), 10).select("filename", "created", T.human_size(F.col("size")).alias("shown"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = read(spark, sf_dir, name).schema
    found = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(found if _is_folder(spark, found) else f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.daily_counts(feeds.with_event_time(_stream(spark, sf_dir, "events"), "ts"), "ts", "event_type")
    return feeds.run_available(stream, "daily_stream", mode="complete")


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.with_event_time(_stream(spark, sf_dir, "events"), "ts", "100 days").select("user_id", "ts")
    return feeds.run_available(feeds.deduplicated(stream, "user_id").select("user_id"), "dedup_stream")


def notification_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.notifications(_stream(spark, sf_dir, "events"), 100, "event_id").select("event_id", "event_type")
    return feeds.run_available(stream, "notification_stream")


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts about the orders of each micro-batch."""
    d = domain(spark, sf_dir)
    of = feeds.batch_alerts(d, CLOCK, high=HIGH, hours=OLD, suspicious=SUSPICIOUS, new=NEW)
    return feeds.run_available(_stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "alert_stream", each=lambda batch: of(d.commandes.join(batch, "id", "left_semi")))


def overdue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are pending a day after they came, by the newest order's time."""
    orders = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderstatus") == "P").alias("pending"))
    found = feeds.run_available(feeds.overdue(orders.withWatermark("at", "0 seconds"), OLD), "overdue_stream")
    return found.select("id", F.col("since").cast("timestamp_ntz").alias("since"))


def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages out of JSON lines, as a webhook lands them."""
    c = F.col
    message = F.struct(F.concat(F.lit("whatsapp:+212"), c("conv_id").cast("string")).alias("From"), c("text").alias("Body"), F.when(c("turn") % 3 == 2, "x").otherwise((c("turn") % 3).cast("string")).alias("NumMedia"), F.lit("audio/ogg").alias("MediaContentType0"))
    lines = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(message).alias("value"))
    return feeds.run_available(feeds.webhook_messages(lines), "webhook_stream").select("conv_id", "turn", "sender", "phone", "n_media", "kind", "subject", F.md5(c("content").cast("binary")).alias("content_md5"))


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that the session's catalogue lists under this library's names."""
    d = domain(spark, sf_dir)
    for name in ("clients", "produits", "commandes"):
        getattr(d, name).createOrReplaceTempView(f"ordermill_{name}")
    return metrics.any_table_counts(spark, sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("ordermill_")))


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients as they come back from a compressed snapshot."""
    d, folder = domain(spark, sf_dir), own_folder(spark, "backups")
    export.snapshot({"clients": d.clients, "produits": d.produits}, folder, "20010801_000000", compress=True)
    return export.restore(spark, folder, "backup_20010801_000000", {"clients": d.clients, "produits": d.produits}, "20010801_000001")["clients"]


def csv_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products through CSV files that begin with a byte order mark."""
    folder = own_folder(spark, "csv")
    export.write_csv(domain(spark, sf_dir).produits, folder, mark=True)
    return spark.read.option("header", True).csv(folder).toDF("id", "type").select(F.col("id").cast("long").alias("id"), "type")


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backup history after three backups."""
    folder = own_folder(spark, "history")
    for i in range(1, 4):
        export.append_history(spark, folder, f"backup_2001080{i}_000000.db", 1000 * i, f"2001-08-0{i}T00:00:00", "orders.db")
    return spark.read.schema("filename string, size long, date string, db_path string").json(f"{folder}/backup_history.json")


def _iso(d: Domain) -> DataFrame:
    """Times as ISO texts, some of them spoilt."""
    key, at = F.col("id"), F.col("created_at")
    text = F.when(key % 5 == 0, F.date_format(at, "yyyy-MM-dd")).when(key % 5 == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(key % 5 == 2, F.lit("bientôt")).when(key % 5 == 3, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"))
    return d.commandes.select("id", text.alias("text"), "created_at")


def _answers(d: Domain) -> DataFrame:
    """A model's answers about orders: fenced, bare and broken JSON."""
    key = F.col("id")
    inner = F.concat(F.lit('{"is_reorder": '), F.when(key % 2 == 0, "true").otherwise("false"), F.lit(', "client_name": "C'), key.cast("string"), F.lit('", "confidence": '), (key % 100).cast("string"), F.lit("}"))
    text = F.when(key % 4 == 0, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).when(key % 4 == 1, inner).when(key % 4 == 2, F.concat(F.lit("```\n"), inner, F.lit("\n```"))).otherwise("désolé")
    return d.commandes.select("id", T.answered(text, "is_reorder boolean, client_name string, confidence long").alias("a")).select("id", "a.*")


def _alerts(d: Domain) -> DataFrame:
    return alerts.alerts(d, CLOCK, HIGH, OLD, SUSPICIOUS, NEW)


c = F.col
QUERIES: dict[str, Query] = {
    "a1_stats": _orders(metrics.stats),
    "a2_clients_with_orders": _orders(metrics.clients_with_orders),
    "a3_top_clients": _on(metrics.top_clients),
    "a4_top_products": _on(metrics.top_products),
    "a6_revenue": _orders(lambda d: metrics.sum_and_mean(d, "prix_total", "total_revenue", "avg_order_value")),
    "a7_quantity": _on(lambda d: metrics.sum_and_mean(d, "quantite", "total_quantity", "avg_quantity")),
    "a8_orders_by_product": _on(metrics.orders_by_product),
    "a9_by_status": _orders(metrics.by_status),
    "a10_top_clients_revenue": _on(metrics.top_clients_by_orders),
    "a11_daily_30d": _orders(lambda d: metrics.daily_counts(d, CLOCK)),
    "a12_monthly": _orders(metrics.monthly),
    "a13_trend": _orders(lambda d: metrics.trend(d, CLOCK)),
    "a14_trend_zero_filled": _orders(lambda d: metrics.trend_filled(d, CLOCK)),
    "a15_channel_split": _orders(metrics.channel_split),
    "a16_weekly_volume": _on(lambda d: metrics.daily_volume(d, CLOCK)),
    "a17_source_validation": _orders(metrics.channel_validation),
    "a18_processing_hours": _on(metrics.processing_hours),
    "a19_product_revenue": _on(metrics.product_revenue),
    "a20_segments": _orders(lambda d: metrics.segments(d, 12, 6)),
    "a21_kpis": _orders(metrics.kpis),
    "a22_client_share": _on(metrics.client_share),
    "a23_erp_stats": _on(metrics.erp_stats),
    "a24_top_codes": _on(metrics.top_codes),
    "a25_channel_page": _orders(lambda d: metrics.channel_page(d, CLOCK)),
    "a26_avg_qty_nonzero": _on(metrics.mean_quantity),
    "a27_favourites": _on(lambda d: profile.favourites(d, 3)),
    "a29_quantity_baseline": _on(metrics.quantity_baseline),
    "a30_unit_price": _on(metrics.unit_price),
    "a31_newest_id": _orders(metrics.newest_id),
    "a32_table_counts": _orders(metrics.table_counts),
    "a33_channel_clients": _orders(metrics.channel_clients),
    "a34_alerts_by_severity": _on(lambda d: alerts.by_severity(_alerts(d))),
    "j1_order_detail": _on(lambda d: joins.order_view(Domain(d.clients, d.produits, d.commandes.filter("id = 1"))).select("id", "client_nom", "client_email", "client_telephone", "produit_type", "quantite", "statut")),
    "j2_orders_joined": _on(lambda d: joins.order_view(d).select("id", "client_nom", "produit_type", "statut", "quantite", "created_at")),
    "j3_orders_products": _on(lambda d: joins.with_product(d).filter("statut = 'en_attente'").select("id", "produit_type", "quantite")),
    "j9_client_counts": _orders(lambda d: joins.client_order_counts(d.commandes).filter("client_orders <= 3").select("id", "client_id", "client_orders")),
    "j10_fuzzy": _on(_fuzzy),
    "j11_processed_semi": _on(lambda d: joins.processed(d.commandes, incoming(d)).select("row", "email_id")),
    "j12_new_orders_anti": _on(lambda d: joins.unprocessed(d.commandes, incoming(d)).select("row", "numero_commande", "email_id")),
    "j14_product_by_name": _on(lambda d: joins.product_by_name(d.produits.select(c("id").alias("row"), F.lower(F.substring("type", 1, 4)).alias("wanted")), d.produits)),
    "w1_frequency": _orders(windows.frequency),
    "w2_typical": _on(windows.typical),
    "w3_first_last": _orders(windows.first_and_last),
    "w4_last_valid": _on(lambda d: windows.last_reference(d).select("client_id", "order_id", "statut", "created_at")),
    "w5_ranked": _orders(windows.ranked_clients),
    "l1_recent": _orders(metrics.recent),
    "l6_last_months_ascending": _orders(lambda d: metrics.monthly(d, 6, newest_first=False)),
    "u1_alerts": _on(_alerts),
    "u3_codes": lambda spark, sf_dir: codes.standard_codes(spark),
    "t1_code_generate": _on(lambda d: _text(d).select("id", codes.article_code(c("paper"), c("grammage"), c("laize"), F.when(c("id") % 2 == 0, "Nordic")).alias("code"))),
    "t2_code_parse": _on(lambda d: d.commandes.select("id", codes.parsed_code(F.concat("code_article", F.when(c("id") % 3 == 0, "MON").when(c("id") % 3 == 1, "XYZ").otherwise(""))).alias("p")).select("id", "p.*")),
    "t3_code_suggest": _on(lambda d: _text(d).select("id", codes.suggested_code(c("description")).alias("code"))),
    "t6_bulk_codes": _on(lambda d: ingest.assign_codes(_uncoded(d))),
    "t7_reorder": lambda spark, sf_dir: read(spark, sf_dir, "conversations").select("conv_id", "turn", T.asks_again(F.concat(F.coalesce("text", F.lit("")), F.when(c("turn") % 5 == 0, " Comme d'habitude").otherwise(""))).alias("asks_again")),
    "t8_fill_history": _on(_filled),
    "t10_profile": _on(profile.profiles),
    "t11_prediction": _on(lambda d: profile.predictions(d, 200000, 50000)),
    "t12_anomalies": _on(profile.anomalies),
    "t13_insights": _on(profile.insights),
    "p1_by_id": _orders(lambda d: d.commandes.filter("id = 7").select("id", "client_id", "statut", "prix_total")),
    "p2_by_status": _orders(lambda d: d.commandes.filter(export.filters("en_attente")).select("id", "client_id", "created_at")),
    "p6_preferences": _on(lambda d: profile.client_preferences(d, "CUSTOMER#000000001").select("client_id", "nom", "total_orders", "total_spent")),
    "p8_urgent": _orders(lambda d: d.commandes.filter(c("email_subject").ilike("%urgent%") & (c("statut") == "en_attente")).select("id", "email_subject")),
    "p9_high_quantity": _on(lambda d: d.commandes.filter((c("quantite") > HIGH) & (c("statut") == "en_attente")).select("id", "quantite")),
    "p11_stale": _orders(lambda d: d.commandes.filter((c("statut") == "en_attente") & (CLOCK.hours_since(c("created_at")) > OLD * 365)).select("id", F.floor(CLOCK.hours_since(c("created_at"))).alias("hours"))),
    "p12_filtered_export": _orders(lambda d: d.commandes.filter(export.filters("validee", None, "1997-01-01", "1997-06-30")).select("id", "statut", "created_at")),
    "p13_blank": _on(lambda d: d.commandes.agg(metrics.count_where(~T.blank(c("code_article"))).alias("coded"), metrics.count_where(T.blank(c("code_article"))).alias("blank"))),
    "p19_client_buckets": _orders(lambda d: profile.client_buckets(d, "customer", "5-10").select("id", "nom", "order_count")),
    "f1_client_code": _on(lambda d: d.clients.select("id", T.client_code(c("id") * 97).alias("code"))),
    "f2_fallback": _on(lambda d: d.commandes.select("id", T.filled(c("code_article"), c("numero_commande"), F.concat(F.lit("CMD-"), c("id").cast("string"))).alias("shown"))),
    "f4_normalized": _on(lambda d: d.clients.select("id", T.normalized_name(F.concat(F.lit("Société M'hamid-Café. "), c("nom"))).alias("norm"))),
    "f7_phone": _on(lambda d: d.clients.select("id", T.international(F.concat(F.lit("whatsapp:"), F.coalesce("telephone", F.lit("06 12 34")))).alias("phone"), T.channel_address(F.coalesce("telephone", F.lit("212"))).alias("address"))),
    "f10_media": lambda spark, sf_dir: _messages(spark, sf_dir).select("event_id", T.media_kind(c("body"), c("n_media"), c("media_type")).alias("kind"), T.audio_extension(c("media_type")).alias("extension")),
    "f14_source": _orders(lambda d: d.commandes.select("id", T.resolved_source(c("source"), F.when(c("id") % 2 == 0, F.concat(F.lit("WhatsApp "), "email_subject")).otherwise(c("email_subject"))).alias("source"))),
    "f17_shortened": _on(lambda d: d.commandes.select("id", T.shortened(c("nature_produit"), 10).alias("shown"))),
    "m1_resolve_clients": _on(lambda d: ingest.resolve_clients(d.clients, _requests(d))),
    "m2_new_orders": _on(lambda d: ingest.new_orders(d, incoming(d)).select("row", "id", "client_id", "code_client", "produit_id", "numero_commande", "ligne_commande", "site_vente", "quantite", "quantite_livree", "reste_a_livrer", "quantite_facturee", "unite", "devise", "commercial", "source", "email_id", "statut")),
    "m3_status_change": _on(lambda d: ingest.apply_status(d.commandes.withColumn("motif_rejet", F.when(c("statut") == "rejetee", F.lit("ancien"))), _status_changes(d)).select("id", "statut", "validated_at", "validated_by", "motif_rejet")),
    "m4_field_change": _on(lambda d: ingest.apply_fields(d.commandes, d.commandes.select("id", F.when(c("id") % 6 == 0, c("quantite") + 10).alias("quantite"), F.when(c("id") % 6 == 0, F.lit(77)).cast("long").alias("laize"), F.lit("x").alias("statut"))).select("id", "quantite", "laize", "statut", "reste_a_livrer")),
    "m5_soft_delete": _on(lambda d: ingest.soft_delete(d.commandes, d.commandes.filter("statut = 'rejetee' and quantite > 100")).groupBy("statut").agg(F.count("*").alias("orders"))),
    "m6_source_repair": _on(lambda d: ingest.repair_source(d.commandes.withColumn("email_subject", F.when(c("id") % 8 == 0, F.concat(F.lit("Msg whatsapp "), "email_subject")).otherwise(c("email_subject")))).select("id", "source")),
    "m7_phone_backfill": _on(lambda d: ingest.backfill_phones(d.clients.withColumn("nom", F.when(c("id") % 2 == 0, F.concat("nom", F.lit(" +2127"), c("id").cast("string"))).otherwise(c("nom")))).select("id", "telephone")),
    "m8_remove": _on(lambda d: ingest.remove(d.clients, c("email").ilike("c1%")).select("id", "email")),
    "k2_erp_export": _on(lambda d: export.erp_rows(d, status="validee").select("numero_commande", "ligne_commande", "site_vente", "code_client", "client_nom", "code_article", "quantite", "quantite_livree", "reste_a_livrer", "commercial", "grammage", "laize", "prix_total", "devise", "statut", "confiance", "source", "created_at")),
    "k4_json_counts": _on(lambda d: export.as_json(d.produits).select("json")),
    "k7_retention": _on(lambda d: _expired(_backups(d))),
    "k1_flat_export": _on(export.flat_rows),
    "k14_audit": _orders(lambda d: ingest.audit("UPDATE", "commandes", d.commandes, "Statut modifié")),
    "s6_newest_mails": lambda spark, sf_dir: inbox.newest(read(spark, sf_dir, "events").select("event_id", "event_type"), 5, "event_id"),
    "s7_unseen": lambda spark, sf_dir: inbox.unseen(read(spark, sf_dir, "events").select("event_id", F.when(c("event_id") % 3 != 0, c("event_id") % 2 == 0).alias("seen"))).select("event_id"),
    "l4_log_tail": _orders(lambda d: inbox.newest(ingest.audit("CREATE", "commandes", d.commandes, ""), 50, "record_id").select("record_id", "action")),
    "l5_clients_recent": _orders(lambda d: inbox.sorted_clients(metrics.clients_with_orders(d), "recent").select("id", "nom", "order_count")),
    "d10_time_ago": lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", T.time_ago(c("event_id") * 37).alias("shown")),
    "d11_next_slot": lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", inbox.next_slot(Clock("2001-08-31 22:10:00"), c("event_id") % 12 + 1).alias("at")),
    "n10_thousands": _orders(lambda d: d.commandes.select("id", inbox.thousands(c("id") * 1000 + 0.4).alias("shown"))),
    "p14_routable": _on(lambda d: d.clients.agg(metrics.count_where(T.routable(c("email"))).alias("routable"))),
    "p15_complete_fields": _on(lambda d: d.commandes.filter("code_article is not null and grammage is not null and laize is not null").select("id", "code_article")),
    "p16_generic_names": _on(lambda d: d.clients.select("id", T.generic_name(F.when(c("id") % 3 == 0, F.concat(F.lit("Client WhatsApp "), "nom")).otherwise(c("nom"))).alias("is_generic"))),
    "t5_auto_code": _on(lambda d: _text(d).join(d.commandes.select("id", "code_article"), "id").select("id", inbox.auto_code(c("code_article"), F.when(c("id") % 2 == 0, c("description")), c("paper"), c("grammage"), c("laize")).alias("code"))),
    "t9_suggest_reorder": _on(_suggested),
    "r1_notification_stream": notification_stream,
    "r2_dedup_stream": dedup_stream,
    "r3_daily_stream": daily_stream,
}
QUERIES |= {
    "s4_catalogue_counts": catalogue_counts,
    "s8_webhook_stream": webhook_stream,
    "r4_alert_stream": alert_stream,
    "r6_overdue_stream": overdue_stream,
    "k2_erp_headers": _on(lambda d: export.erp_export(d, status="validee")),
    "k3_csv": csv_and_back,
    "k4_json_tables": _on(lambda d: export.all_as_json({"clients": d.clients, "produits": d.produits, "commandes": d.commandes})),
    "k5_restored": restored,
    "k8_history": history_lines,
    "s13_shown_backups": _on(lambda d: export.shown_backups(_backups(d))),
    "t6_bulk_counts": _on(lambda d: ingest.code_counts(ingest.assign_codes(_uncoded(d)))),
    "t6_bulk_results": _on(lambda d: ingest.code_results(ingest.assign_codes(_uncoded(d)))),
    "m2_placed": _on(lambda d: ingest.placed(d.commandes, incoming(d))),
    "m7_rename_by_phone": _on(lambda d: ingest.rename_by_phone(d.clients.withColumn("nom", F.when(c("id") % 3 == 0, F.concat(F.lit("Client WhatsApp "), c("id").cast("string"))).otherwise(c("nom"))), d.clients.select("telephone", F.concat(F.lit("Société "), (c("id") % 10).cast("string")).alias("real_name"))).select("id", "nom", "telephone")),
    "u4_seeded": lambda spark, sf_dir: ingest.seeded(domain(spark, sf_dir).produits, spark.createDataFrame([(1, "Sachets fond plat"), (9001, "Sachets fond plat"), (9002, "Sac fond carré sans poignées"), (9002, "Sac fond carré avec poignées plates"), (9003, "Sac fond carré avec poignées torsadées")], "id long, type string")),
    "a35_dashboard_rates": _on(metrics.dashboard_rates),
    "a36_unread": lambda spark, sf_dir: metrics.unread(read(spark, sf_dir, "events").select(F.when(c("event_id") % 3 != 0, c("event_id") % 2 == 0).alias("is_read"))),
    "n12_revenue_k": _orders(metrics.revenue_in_thousands),
    "n3_rounded": _orders(lambda d: d.commandes.select("id", numbers.rounded(c("id") / F.lit(80.0)).alias("one"), numbers.whole(c("id") / F.lit(2.0)).alias("none"))),
    "d8_iso_times": _orders(lambda d: _iso(d).select("id", iso_time(c("text")).alias("at"))),
    "d12_slices": _orders(lambda d: d.commandes.select("id", day_shown(c("created_at")).alias("day"), minute_shown(c("created_at")).alias("minute"), month_day_shown(F.to_date("created_at")).alias("month_day"))),
    "f6_phone_in": _on(lambda d: d.clients.select("id", T.phone_in(F.concat("nom", F.lit(" tel "), F.coalesce("telephone", F.lit("?")))).alias("phone"), T.phone_tail(F.concat("nom", F.coalesce("telephone", F.lit("")))).alias("tail"))),
    "f12_file_kind": _orders(lambda d: d.commandes.select("id", T.file_kind(F.concat(F.lit("Piece."), F.element_at(F.array(*map(F.lit, ("PDF", "jpg", "csv", "docx", "txt", "webp"))), (c("id") % 6 + 1).cast("int")))).alias("kind"))),
    "f15_shown": _orders(lambda d: d.commandes.select("id", T.order_number(c("numero_commande"), c("id")).alias("number"), T.delivery_shown(F.when(c("id") % 3 == 0, "None").when(c("id") % 3 == 1, "2001-08-09")).alias("delivery"))),
    "f15_product": _on(lambda d: joins.with_product(d).select("id", T.product_shown(F.when(c("id") % 3 != 0, c("produit_type")), c("nature_produit")).alias("product"), T.amount_shown(c("quantite").cast("long"), c("unite")).alias("amount"))),
    "f16_answers": _orders(_answers),
    "f18_labels": _on(lambda d: d.commandes.select("id", T.status_label(c("statut")).alias("status"), T.source_label(c("source")).alias("channel"), T.initial(c("nature_produit")).alias("initial"))),
    "f20_headers": _orders(lambda d: d.commandes.select("id", inbox.decoded_header(c("email_subject")).alias("subject"))),
    "f21_prompt": _on(lambda d: d.commandes.select("id", T.prompt_part(c("nature_produit"), 12).alias("part"))),
    "f22_mail_content": _on(lambda d: d.commandes.select("id", F.md5(T.mail_content(c("email_subject"), c("source"), day_shown(c("created_at")), c("nature_produit"), F.when(c("id") % 2 == 0, F.array(F.struct(F.lit("a.txt").alias("filename"), c("devise").alias("text")))).otherwise(F.array().cast("array<struct<filename:string,text:string>>"))).cast("binary")).alias("content_md5"))),
    "p19_client_source": _orders(lambda d: profile.client_buckets(d, source="email").select("id", "nom", "order_count")),
    "p19_whatsapp_clients": _orders(lambda d: profile.client_buckets(d, bucket="1-5", source="whatsapp").select("id", "nom", "order_count")),
    "l5_clients_name": _orders(lambda d: inbox.sorted_clients(metrics.clients_with_orders(d), "name").select("id", "nom", "order_count")),
    "l5_clients_orders_desc": _orders(lambda d: inbox.sorted_clients(metrics.clients_with_orders(d), "orders_desc").select("id", "nom", "order_count")),
    "l5_clients_orders_asc": _orders(lambda d: inbox.sorted_clients(metrics.clients_with_orders(d), "orders_asc").select("id", "nom", "order_count")),
}
