"""Every query with SQL against DuckDB over the smallest tables, and the operators' own cases."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ordermill.functions.clock import Clock
from ordermill.operators import alerts, export, ingest, joins, metrics, windows
from ordermill.plans.oracle import ORACLE
from ordermill.plans.queries import QUERIES
from ordermill.sources.bridge import Domain

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return float(value) if hasattr(value, "is_finite") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def small(spark):
    """Three clients, one order without a client, nulls all over."""
    clients = spark.createDataFrame([(1, "Atlas", "a@x", None), (2, "Société Café", None, "+2121"), (3, "Client WhatsApp 9", None, "+2129")], "id long, nom string, email string, telephone string")
    produits = spark.createDataFrame([(1, "Sachets fond plat"), (2, "Sac fond carré")], "id long, type string")
    rows = [
        (1, 1, 1, "A", 12000.0, 2000.0, "en_attente", "email", "URGENT svp", 50, "2001-07-31 12:00:00", None),
        (2, 1, 2, "B", 10.0, 20.0, "validee", None, None, 90, "2001-07-01 00:00:00", "2001-07-02 00:00:00"),
        (3, 2, None, None, None, None, "en_attente", "whatsapp", None, None, "2001-08-01 00:00:00", None),
        (4, None, 1, "", 6000.0, 0.0, "en_attente", None, None, 70, "2001-07-31 00:00:00", None),
    ]
    x = spark.createDataFrame(rows, "id long, client_id long, produit_id long, numero_commande string, quantite double, prix_total double, statut string, source string, email_subject string, confiance int, created_at string, validated_at string")
    x = x.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("validated_at", F.col("validated_at").cast("timestamp_ntz")).withColumn("nature_produit", F.lit("x")).withColumn("quantite_livree", F.lit(1.0)).withColumn("email_id", F.concat(F.lit("m"), "id"))
    return Domain(clients, produits, x)


def test_alerts_with_the_real_thresholds(small):
    got = {(r["order_id"], r["type"]): r["message"] for r in alerts.alerts(small, Clock()).collect()}
    assert set(got) == {(1, "urgent"), (1, "high_quantity"), (1, "low_confidence"), (4, "suspicious")}
    assert got[4, "suspicious"] == "⚠️ Nouveau client avec grande commande: None (6000.0 unités)" and got[1, "urgent"].endswith("A - Atlas")


def test_empty_tables(spark, small):
    empty = Domain(small.clients.limit(0), small.produits.limit(0), small.commandes.limit(0))
    assert metrics.kpis(empty).first()["validation_rate"] == 0.0 and metrics.stats(empty).first()["total_clients"] == 0
    assert metrics.sum_and_mean(empty, "prix_total", "a", "b").first()["a"] == 0.0
    assert windows.frequency(empty).count() == 0 and alerts.alerts(empty, Clock()).count() == 0 and metrics.newest_id(empty).first()["last_id"] == 0


def test_filters_of_bare_dates(small):
    ids = lambda **k: sorted(r["id"] for r in small.commandes.filter(export.filters(**k)).select("id").collect())
    assert ids(date_to="2001-07-31") == [2] and ids(date_to="2001-07-31", whole_day=True) == [1, 2, 4]
    assert ids(date_to="2001-07-31 00:00:00") == [2, 4] and ids(date_from="2001-07-31") == [1, 3, 4] and ids(status="validee", client_id=1) == [2]


def test_fuzzy_match_folds_accents(spark, small):
    asked = spark.createDataFrame([(1, "societe CAFE"), (2, "nobody"), (3, None)], "search_id long, search string")
    assert [(r["search_id"], r["client_id"], round(r["score"], 2)) for r in joins.fuzzy_match(asked, small.clients).collect()] == [(1, 2, 1.3)]


def test_clients_are_resolved_as_if_one_by_one(spark, small):
    asked = [(1, "ATLAS", None, None), (2, "Neuf", None, "+1"), (3, "neuf", None, None), (4, "Client WhatsApp", None, "+2129"), (5, None, "z@z", None), (6, "Client Inconnu", None, None), (7, "Client Inconnu", None, None), (8, "", None, None)]
    got = {r["row"]: (r["client_id"], r["created"]) for r in ingest.resolve_clients(small.clients, spark.createDataFrame(asked, "row long, nom string, email string, telephone string")).collect()}
    assert got == {1: (1, False), 2: (4, True), 3: (4, False), 4: (3, False), 5: (5, True), 6: (6, True), 7: (7, True), 8: (8, True)}


def test_status_and_field_changes(spark, small):
    changes = spark.createDataFrame([(1, "validee", "2001-08-01 00:00:00", None), (3, "rejetee", None, "stock")], "id long, new_statut string, at string, motif string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r["id"]: r for r in ingest.apply_status(small.commandes, changes).collect()}
    assert got[1]["validated_at"] is not None and got[3]["motif_rejet"] == "stock" and got[2]["statut"] == "validee" and got[4]["statut"] == "en_attente"
    fields = spark.createDataFrame([(1, 50.0, "hacked")], "id long, quantite double, statut string")
    got = {r["id"]: r for r in ingest.apply_fields(small.commandes, fields).collect()}
    assert got[1]["quantite"] == 50.0 and got[1]["reste_a_livrer"] == 49.0 and got[1]["statut"] == "en_attente"


def test_exports_and_snapshots(spark, small, tmp_path):
    assert export.erp_export(small).columns == [h for h, _ in export.ERP_HEADERS] and len(export.ERP_HEADERS) == 27
    tables = {"clients": small.clients, "commandes": small.commandes}
    export.snapshot(tables, str(tmp_path), "20010801_000000", compress=True)
    back = export.restore(spark, str(tmp_path), "backup_20010801_000000", tables, "x")
    assert {t: df.count() for t, df in back.items()} == {"clients": 3, "commandes": 4} and (tmp_path / "pre_restore_x" / "clients").is_dir()
    assert export.restore(spark, str(tmp_path), "none", tables, "y") is None
    export.write_csv(small.clients, str(tmp_path / "csv"))
    export.write_json(small.clients, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 3


def test_history_fills_blanks_only(spark, small):
    x = spark.createDataFrame([(1, 1, "", 0.0, None, 10), (2, 1, "own", 5.0, 7.0, 10), (3, 9, None, None, None, None)], "row long, client_id long, nature_produit string, quantite double, prix_total double, confiance int")
    got = {r["row"]: r for r in ingest.fill_from_history(x, windows.last_reference(small)).collect()}
    assert got[1]["history_fields"] == ["nature_produit", "quantite", "prix_total"] and got[1]["confiance"] == 85 and got[1]["history_source_order"] == "B"
    assert got[2]["history_fields"] == [] and got[2]["confiance"] == 10 and got[3]["history_fields"] == [] and got[3]["confiance"] is None


def test_plans_prune_and_push(spark):
    """The scan of orders reads what is needed, and filters reach it."""
    from ordermill.sources.bridge import domain

    plan = domain(spark, SF).commandes.filter("id > 100").select("id", "statut")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "o_totalprice" not in plan
    plan = metrics.recent(domain(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
