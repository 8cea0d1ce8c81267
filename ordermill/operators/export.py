"""Filtered views, ERP and flat exports, snapshots with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import client_code, human_size
from ..sources.bridge import Domain
from .joins import order_view, with_client

#: Headers of the ERP export, in their order, and the columns under them.
ERP_HEADERS = [
    ("Numéro commande", "numero_commande"), ("Ligne commande", "ligne_commande"), ("Site de vente", "site_vente"), ("Code client", "code_client"),
    ("Raison sociale", "client_nom"), ("Code article", "code_article"), ("Désignation", "nature_produit"), ("Date commande", "date_commande"),
    ("Date livraison prévue", "date_livraison"), ("Qtée commandée US", "quantite"), ("Qté Livrée US", "quantite_livree"), ("Reste à livrer US", "reste_a_livrer"),
    ("Qtée facturée US", "quantite_facturee"), ("Commercial", "commercial"), ("Type SAC", "type_sac"), ("Format LAR.PRE.LON", "format_sac"),
    ("Type de papier", "type_papier"), ("Grammage", "grammage"), ("Laize", "laize"), ("Impression client", "impression_client"),
    ("Prix unitaire", "prix_unitaire"), ("Prix total", "prix_total"), ("Devise", "devise"), ("Statut", "statut"),
    ("Confiance IA (%)", "confiance"), ("Source", "source"), ("Date création", "created_at"),
]
#: What a new order has where nothing is given.
DEFAULTS = {"ligne_commande": 1, "site_vente": "SXP", "unite": "US", "devise": "MAD", "commercial": "DIVERS", "quantite_facturee": 0.0}


def filters(status: str | None = None, client_id: int | None = None, date_from: str | None = None, date_to: str | None = None, whole_day: bool = False) -> Column:
    """All given conditions. A bare date_to leaves that day out, midnight included, unless whole_day is asked for; a full
    time is inclusive. date_from keeps its midnight."""
    out = F.lit(True)
    if status:
        out = out & (F.col("statut") == status)
    if client_id:
        out = out & (F.col("client_id") == client_id)
    if date_from:
        out = out & (F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        end = F.lit(date_to).cast("timestamp_ntz")
        if len(date_to) > 10:
            out = out & (F.col("created_at") <= end)
        else:
            out = out & (F.col("created_at") < (F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz") if whole_day else end))
    return out


def erp_rows(d: Domain, **given) -> DataFrame:
    """Orders under the names of their columns, with defaults for those that the table lacks, newest first."""
    x = with_client(Domain(d.clients, d.produits, d.commandes.filter(filters(**given))))
    if "code_client" not in x.columns:
        x = x.withColumn("code_client", client_code(F.col("client_id")))
    for _, name in ERP_HEADERS:
        if name not in x.columns:
            x = x.withColumn(name, F.lit(DEFAULTS.get(name)) if name in DEFAULTS else F.lit(None).cast("string"))
    return x.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def erp_export(d: Domain, **given) -> DataFrame:
    """The 27 columns of the ERP import, under its headers."""
    return erp_rows(d, **given).select(*[F.col(name).alias(header) for header, name in ERP_HEADERS])


#: The columns of the flat export, in their order.
FLAT_COLUMNS = (
    "id", "numero_commande", "ligne_commande", "site_vente", "code_client", "client", "code_article", "produit", "nature_produit",
    "quantite", "unite", "quantite_livree", "reste_a_livrer", "quantite_facturee", "prix_unitaire", "prix_total", "devise",
    "date_commande", "date_livraison", "commercial", "type_sac", "format_sac", "type_papier", "grammage", "laize",
    "impression_client", "statut", "confiance", "source", "created_at",
)


def flat_rows(d: Domain, **given) -> DataFrame:
    """Orders with the names of their clients and products, under the 30 columns of the flat export."""
    x = order_view(Domain(d.clients, d.produits, d.commandes.filter(filters(**given)))).withColumnsRenamed({"client_nom": "client", "produit_type": "produit"})
    if "code_client" not in x.columns:
        x = x.withColumn("code_client", client_code(F.col("client_id")))
    x = x.withColumns({name: F.lit(DEFAULTS[name]) if name in DEFAULTS else F.lit(None).cast("string") for name in FLAT_COLUMNS if name not in x.columns})
    return x.select(*FLAT_COLUMNS)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header in each file; with `mark`, each begins with a byte order mark, as spreadsheets want it."""
    if mark and df.columns:
        first = df.columns[0]
        df = df.withColumnRenamed(first, f"\ufeff{first}")
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write df as JSON unless it has no rows; whether it was written."""
    if df.isEmpty():
        return False
    write_json(df, path)
    return True


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def all_as_json(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, json of every row of all tables, times as text."""
    out = None
    for name, df in tables.items():
        texts = [F.col(c).cast("string").alias(c) if kind.startswith(("timestamp", "date")) else F.col(c) for c, kind in df.dtypes]
        one = as_json(df.select(*texts)).select(F.lit(name).alias("table_name"), "json")
        out = one if out is None else out.unionByName(one)
    return out


def append_history(spark: SparkSession, folder: str, filename: str, size: int, at: str, source: str) -> None:
    """One more line in the folder's backup history."""
    spark.createDataFrame([(filename, size, at, source)], "filename string, size long, date string, db_path string").write.mode("append").json(f"{folder}/backup_history.json")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, size of the backup files in a folder, newest name first; their content is not read."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "backup_*").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"))
    return x.filter(F.col("filename").rlike(r"\.db(\.gz)?$")).orderBy(F.desc("filename"))


def shown_backups(backups: DataFrame) -> DataFrame:
    """Backups (filename, size) as listed: size and date in words, N/A where the name has none, and whether compressed."""
    return listed(backups).select("filename", "size", human_size(F.col("size")).alias("size_formatted"), F.coalesce(F.date_format("created", "dd/MM/yyyy HH:mm:ss"), F.lit("N/A")).alias("date"), F.col("filename").endswith(".gz").alias("compressed"))


def snapshot(tables: dict[str, DataFrame], folder: str, stamp: str, compress: bool = False) -> str:
    """Write all tables as backup_<stamp>; returns its path."""
    path = f"{folder}/backup_{stamp}"
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip" if compress else "none").parquet(f"{path}/{name}")
    return path


def restore(spark: SparkSession, folder: str, name: str, current: dict[str, DataFrame], stamp: str) -> dict[str, DataFrame] | None:
    """The tables of a snapshot, after writing the current ones as pre_restore_<stamp>; None if there is no such snapshot."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    for table, df in current.items():
        df.write.mode("overwrite").parquet(f"{folder}/pre_restore_{stamp}/{table}")
    return {table: spark.read.parquet(f"{folder}/{name}/{table}") for table in current}


def listed(backups: DataFrame) -> DataFrame:
    """Backups (filename, size) with the time in their names, null where there is none."""
    stamp = F.nullif(F.regexp_extract("filename", r"backup_(\d{8}_\d{6})", 1), F.lit(""))
    return backups.withColumn("created", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"))


def expired(backups: DataFrame, keep: int = 10) -> DataFrame:
    """Backups beyond the newest by name. A listing of files is short, so one window over all is fine."""
    rank = F.row_number().over(Window.orderBy(F.desc("filename")))
    return backups.withColumn("rank", rank).filter(F.col("rank") > keep)
