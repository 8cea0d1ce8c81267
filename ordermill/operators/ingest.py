"""Batch ingest: client resolution, new orders, filling from history, and changes as functions of a table.

Tables here have no transactions: each function takes a base and changes and returns the new base, for a single writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import text as T
from ..session import cut
from ..sources.bridge import Domain
from .joins import first_come, product_by_name, unprocessed, with_product

#: Columns that a user may change.
EDITABLE = (
    "code_article", "nature_produit", "quantite", "quantite_livree", "quantite_facturee", "prix_unitaire", "prix_total",
    "type_sac", "format_sac", "type_papier", "grammage", "laize", "impression_client", "commercial",
)
#: The confidence that filling from history gives at least.
FILLED_CONFIDENCE = 85
FILLABLE = ("type_produit", "nature_produit", "quantite", "unite", "prix_unitaire", "prix_total", "devise")


def requested_name(nom: Column, email: Column, telephone: Column) -> Column:
    return F.when(T.blank(T.trimmed(F.coalesce(nom, F.lit("")))), F.coalesce(F.nullif(email, F.lit("")), F.nullif(telephone, F.lit("")), F.lit("Client Inconnu"))).otherwise(nom)


def _requested(requests: DataFrame) -> DataFrame:
    c = F.col
    x = requests.select("row", requested_name(c("nom"), c("email"), c("telephone")).alias("nom"), c("email").alias("given_email"), c("telephone").alias("given_phone"))
    x = x.withColumn("email", F.nullif("given_email", F.lit(""))).withColumn("telephone", F.nullif("given_phone", F.lit("")))
    return x.withColumn("real", ~T.generic_name(c("nom"))).withColumn("name", T.ascii_lower(c("nom")))


def _holders(rows: DataFrame, key: str) -> DataFrame:
    """Of (key, made, since), where `made` orders clients and `since` is the first row that can find one by the key: those
    that some row finds, being before all others that are there by then."""
    x = rows.filter(F.col(key).isNotNull()).groupBy(key, "since").agg(F.min("made").alias("made"))
    earlier = F.min("made").over(Window.partitionBy(key).orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("_least", earlier).filter(F.col("_least").isNull() | (F.col("made") < F.col("_least"))).drop("_least")


def _finds(requests: DataFrame, holders: DataFrame, key: str, out: str) -> DataFrame:
    """row, out: the first client that holds the request's key by then."""
    x = requests.select("row", key).join(holders, key).filter(F.col("since") <= F.col("row"))
    return x.groupBy("row").agg(F.min("made").alias(out))


def resolve_clients(clients: DataFrame, requests: DataFrame) -> DataFrame:
    """row, client_id, created for requests (row, nom, email, telephone), as if they came one by one.

    A real name is looked up by name alone; a generic one by phone, then by mail, among the clients there are by then: those
    of the table, with phones that real names have filled in, and those that earlier rows created. Of several, the one
    with the smallest id is found. New ids follow the largest one in the order of rows. A real name never finds a client
    that a generic one created in the same batch (their names would have to differ in case alone)."""
    assigned, *_ = _resolved(clients, requests)
    return assigned


def clients_after(clients: DataFrame, requests: DataFrame) -> DataFrame:
    """The clients after resolve_clients: those created too, and phones filled in where a real name brought one."""
    assigned, r, first_phone = _resolved(clients, requests)
    new = r.join(assigned.filter("created").select("row", "client_id"), "row").select(F.col("client_id").alias("id"), "nom", F.col("given_email").alias("email"), F.col("given_phone").alias("telephone"))
    x = clients.select("id", "nom", "email", "telephone").unionByName(new)
    phones = first_phone.join(assigned.select(F.col("row").alias("since"), "client_id"), "since").select(F.col("client_id").alias("id"), F.col("telephone").alias("_phone"))
    return x.join(phones, "id", "left").withColumn("telephone", F.coalesce(F.nullif("telephone", F.lit("")), "_phone", "telephone")).drop("_phone")


def _resolved(clients: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = F.col
    r = cut(_requested(requests))
    base = clients.select(F.struct(F.lit(0).alias("kind"), c("id").cast("long").alias("n")).alias("made"), T.ascii_lower(c("nom")).alias("name"), F.nullif("email", F.lit("")).alias("email"), F.nullif("telephone", F.lit("")).alias("telephone"))
    # real names: a client of the table, or the one that the name's first row creates
    by_name = base.filter("name is not null").groupBy("name").agg(F.min("made").alias("known"))
    created = lambda row: F.struct(F.lit(1).alias("kind"), c(row).cast("long").alias("n"))
    names = r.filter("real").groupBy("name").agg(F.min("row").alias("first"), F.min_by("email", "row").alias("email")).join(by_name, "name", "left")
    names = names.withColumn("made", F.coalesce("known", created("first")))
    real = r.filter("real").join(names.select("name", "made"), "name")
    # phones that real names bring: the first one, where the client has none
    without = names.select("made").join(base.select("made", c("telephone").alias("had")), "made", "left").filter("had is null").select("made")
    first_phone = real.filter("telephone is not null").groupBy("made").agg(F.min("row").alias("since"), F.min_by("telephone", "row").alias("telephone")).join(without, "made")
    always = F.lit(-(1 << 62))
    phones = base.select("telephone", "made", always.alias("since")).unionByName(first_phone.select("telephone", "made", (c("since") + 1).alias("since")))
    mails = base.select("email", "made", always.alias("since")).unionByName(names.filter("known is null").select("email", "made", (c("first") + 1).alias("since")))
    # generic names that find none of these create clients, unless an earlier one of them did that they find
    generic = cut(r.filter("not real").select("row", "telephone", "email"))
    known = _finds(generic, _holders(phones, "telephone"), "telephone", "_found").unionByName(_finds(generic, _holders(mails, "email"), "email", "_found"))
    makers = first_come(generic.join(known, "row", "left_anti"), "row", ("telephone", "email"))
    made = generic.join(makers, "row", "left_semi").withColumn("made", created("row")).withColumn("since", c("row") + 1)
    by_phone = _finds(generic, _holders(phones.unionByName(made.select("telephone", "made", "since")), "telephone"), "telephone", "p")
    by_mail = _finds(generic, _holders(mails.unionByName(made.select("email", "made", "since")), "email"), "email", "m")
    found = generic.select("row").join(by_phone, "row", "left").join(by_mail, "row", "left").select("row", F.coalesce("p", "m", created("row")).alias("made"))
    return _numbered(real.select("row", "made").unionByName(found), clients), r, first_phone


def _numbered(r: DataFrame, clients: DataFrame) -> DataFrame:
    """Ids for (row, made): of a client of the table its own, else the largest id plus the rank of the row that creates it,
    ranked within ranges of rows so that no task sorts all of them."""
    x = r.withColumn("creator", F.when(F.col("made.kind") == 1, F.col("made.n")))
    ids = ranked_ids(x.filter("row = creator").select("row"), clients).select(F.col("row").alias("creator"), "new_id")
    x = x.join(ids, "creator", "left")
    return x.select("row", F.coalesce("new_id", F.col("made.n")).alias("client_id"), F.coalesce(F.col("row") == F.col("creator"), F.lit(False)).alias("created"))


def ranked_ids(rows: DataFrame, table: DataFrame, size: int = 100_000) -> DataFrame:
    """row, new_id: ids after the table's largest, in the order of row, ranked within ranges of it."""
    made = rows.select("row", F.floor(F.col("row") / size).alias("range"))
    before = made.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = made.withColumn("i", F.row_number().over(Window.partitionBy("range").orderBy("row"))).join(before, "range")
    largest = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("largest")).withColumn("_", F.lit(1))  # one row
    return ranked.withColumn("_", F.lit(1)).join(F.broadcast(largest), "_").select("row", (F.col("largest") + F.col("before") + F.col("i")).alias("new_id"))


#: The columns of a new order, and what those have that nothing is given for.
ORDER_COLUMNS = (
    "numero_commande", "ligne_commande", "site_vente", "client_id", "code_client", "produit_id", "code_article", "nature_produit",
    "quantite", "unite", "quantite_livree", "reste_a_livrer", "quantite_facturee", "prix_unitaire", "prix_total", "devise",
    "date_commande", "date_livraison", "commercial", "type_sac", "format_sac", "type_papier", "grammage", "laize", "impression_client",
    "informations_supplementaires", "confiance", "source", "email_id", "email_subject", "email_from", "whatsapp_from",
)
ORDER_DEFAULTS = {"ligne_commande": 1, "site_vente": "SXP", "unite": "US", "quantite_facturee": 0.0, "devise": "MAD", "commercial": "DIVERS", "source": "email"}


def _columns(x: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """x with these columns: a default, or null, for those that are absent; a null that is given stays."""
    for name in names:
        if name not in x.columns:
            x = x.withColumn(name, F.lit(ORDER_DEFAULTS[name]) if name in ORDER_DEFAULTS else F.lit(None).cast("string"))
    return x


def sender_requests(incoming: DataFrame) -> DataFrame:
    """row, nom, email, telephone of the client that each order (row, entreprise_cliente, email_from, whatsapp_from) names:
    without a name a WhatsApp sender goes by the number, another by the address."""
    c = F.col
    x = _columns(incoming, ("entreprise_cliente", "email_from", "whatsapp_from"))
    email, phone = T.filled(c("email_from"), c("whatsapp_from")), F.when(~T.blank(c("whatsapp_from")), F.replace("whatsapp_from", F.lit("whatsapp:"), F.lit("")))
    none = T.blank(T.trimmed(F.coalesce("entreprise_cliente", F.lit(""))))
    unnamed = F.when(~T.blank(phone), F.concat(F.lit("Client WhatsApp "), phone)).otherwise(T.filled(email, F.lit("Client Inconnu")))
    return x.select("row", F.when(none, unnamed).otherwise(c("entreprise_cliente")).alias("nom"), email.alias("email"), phone.alias("telephone"))


def new_orders(d: Domain, incoming: DataFrame) -> DataFrame:
    """The rows to append for incoming orders, as if they came one by one: row, id, the columns of ORDER_COLUMNS, statut.

    Repeats by number or email_id are left out; client, client code, product and the rest to deliver are resolved."""
    c = F.col
    x = cut(unprocessed(d.commandes, incoming))
    kinds = product_by_name(_columns(x, ("type_produit",)).select("row", c("type_produit").alias("wanted")).filter(~T.blank(c("wanted"))), d.produits)
    people = resolve_clients(d.clients, sender_requests(x)).select("row", "client_id")
    x = x.drop("produit_id", "client_id").join(kinds.select("row", "produit_id"), "row", "left").join(people, "row").join(ranked_ids(x.select("row"), d.commandes).withColumnRenamed("new_id", "id"), "row")
    x = _columns(x, ("quantite", "quantite_livree", "code_client", *ORDER_COLUMNS))
    for name in ("quantite", "quantite_livree"):
        x = x.withColumn(name, F.coalesce(c(name).cast("double"), F.lit(0.0)))
    x = x.withColumn("reste_a_livrer", c("quantite") - c("quantite_livree")).withColumn("code_client", T.filled(c("code_client"), T.client_code(c("client_id"))))
    return x.select("row", "id", *ORDER_COLUMNS, F.lit("en_attente").alias("statut"))


def placed(orders: DataFrame, incoming: DataFrame) -> DataFrame:
    """row, order_id, created of every incoming order: its own, or that of the order there was by then with its number, or
    else with its email_id."""
    c = F.col
    own = cut(ranked_ids(unprocessed(orders, incoming).select("row"), orders))
    made = incoming.select("row", "numero_commande", "email_id").join(own, "row").withColumnRenamed("row", "_since")
    x = incoming.select("row", "numero_commande", "email_id").join(own, "row", "left")
    for key in ("numero_commande", "email_id"):
        old = orders.filter(~T.blank(c(key))).groupBy(key).agg(F.min("id").alias(f"_{key}"))
        new = made.filter(~T.blank(c(key))).select(key, c("_since"), c("new_id").alias("_new"))  # a key once, as each is taken once
        x = x.join(old, key, "left").join(new, key, "left").withColumn(f"_{key}", F.coalesce(f"_{key}", F.when(c("_since") < c("row"), c("_new")))).drop("_since", "_new")
    return x.select("row", F.coalesce("new_id", "_numero_commande", "_email_id").alias("order_id"), c("new_id").isNotNull().alias("created"))


def seeded(produits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The products with those of a catalogue whose id and type are both new, by id one after the other; the others are
    ignored. The window orders a catalogue, which is a handful of rows."""
    x = catalogue.join(produits.select("id"), "id", "left_anti").join(produits.select("type"), "type", "left_anti")
    x = x.withColumn("_row", F.row_number().over(Window.orderBy("id", "type")))
    x = x.join(first_come(x, "_row", ("id", "type")), "_row", "left_semi")
    return produits.unionByName(x.select(*[c for c in x.columns if c in produits.columns]), allowMissingColumns=True)


def fill_from_history(extracted: DataFrame, reference: DataFrame, fields: tuple[str, ...] = FILLABLE) -> DataFrame:
    """extracted (row, client_id, fields, confiance) with blank or zero fields taken from the client's reference order.

    history_fields lists what was filled, in order; confidence rises to 85 at least where anything was."""
    there = [f for f in fields if f in extracted.columns]
    reference = _with(reference, *there)
    old = reference.select("client_id", F.coalesce(F.nullif(F.col("numero_commande"), F.lit("")), F.concat(F.lit("ID-"), F.col("order_id").cast("string"))).alias("_source"), *[F.col(f).alias(f"_{f}") for f in there])
    x = extracted.join(old, "client_id", "left")
    kinds = dict(extracted.dtypes)
    empty = lambda c, f: c.isNull() | (c == ("" if kinds[f] == "string" else 0))
    takes = {f: empty(F.col(f), f) & ~empty(F.col(f"_{f}"), f) for f in there}
    filled = F.array_compact(F.array(*[F.when(takes[f], F.lit(f)) for f in there]))
    x = x.withColumn("history_fields", filled)
    for f in there:
        x = x.withColumn(f, F.when(F.array_contains("history_fields", f), F.col(f"_{f}")).otherwise(F.col(f)))
    some = F.size("history_fields") > 0
    if "informations_supplementaires" in x.columns:
        note = F.concat(F.lit("[AUTO-REMPLI depuis historique: "), F.array_join("history_fields", ", "), F.lit("] "), F.coalesce("informations_supplementaires", F.lit("")))
        x = x.withColumn("informations_supplementaires", F.when(some, note).otherwise(F.col("informations_supplementaires")))
    x = x.withColumn("confiance", F.when(some, F.greatest(F.coalesce("confiance", F.lit(0)), F.lit(FILLED_CONFIDENCE))).otherwise(F.col("confiance")))
    return x.withColumn("history_source_order", F.when(some, F.col("_source"))).drop("_source", *[f"_{f}" for f in there])


def _order_of(changes: DataFrame, *rest: str) -> Column:
    """What changes of one order follow each other by: `row` where there is one, else their time, else their values."""
    return F.struct(*[c for c in ("row", "at") if c in changes.columns], *[F.col(c).cast("string") for c in rest if c in changes.columns])


def apply_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """orders after changes (id, new_statut, at, motif, and validated_by and row if there), one after the other.

    Validation stamps its time and who did it, rejection keeps its reason; whatever a change does not set stays. An order's
    changes follow each other by `row`, or by `at` where there is none, or by status and reason."""
    c = F.col
    x = _with(changes, "validated_by", "motif")
    last = _order_of(x, "new_statut", "motif")
    valid, rejected = c("new_statut") == "validee", c("new_statut") == "rejetee"
    x = x.filter("new_statut is not null").withColumn("_o", last).groupBy("id").agg(
        F.max_by("new_statut", "_o").alias("new_statut"),
        F.max_by(F.when(valid, F.struct("at", "validated_by")), F.when(valid, c("_o"))).alias("_v"),
        F.max_by("motif", F.when(rejected, c("_o"))).alias("_m"),
        F.max(F.when(rejected, True)).alias("_r"),
    )
    orders = _with(orders, "motif_rejet", "validated_by")
    x = orders.join(x, "id", "left")
    x = x.withColumn("validated_at", F.when(c("_v").isNotNull(), c("_v.at")).otherwise(c("validated_at"))).withColumn("validated_by", F.when(c("_v").isNotNull(), c("_v.validated_by")).otherwise(c("validated_by")))
    x = x.withColumn("motif_rejet", F.when(c("_r"), c("_m")).otherwise(c("motif_rejet")))
    return x.withColumn("statut", F.coalesce("new_statut", "statut")).drop("new_statut", "_v", "_m", "_r")


def _with(x: DataFrame, *names: str) -> DataFrame:
    """x with these text columns, null where they are absent."""
    return x.withColumns({name: F.lit(None).cast("string") for name in names if name not in x.columns})


def apply_fields(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """orders with the editable columns of changes (id, ..., and row if there) taken over where not null; the rest to
    deliver follows. Of several changes of an order the last one by `row` counts, field by field, or the largest value."""
    fields = [f for f in EDITABLE if f in changes.columns and f in orders.columns]
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("row"))) if "row" in changes.columns else F.max(f)
    x = orders.join(changes.groupBy("id").agg(F.lit(True).alias("_changed"), *[last(f).alias(f"_{f}") for f in fields]), "id", "left")
    for f in fields:
        x = x.withColumn(f, F.coalesce(f"_{f}", f))
    rest = F.coalesce("quantite", F.lit(0.0)) - F.coalesce("quantite_livree", F.lit(0.0))
    return x.withColumn("reste_a_livrer", rest).drop("_changed", *[f"_{f}" for f in fields])


def soft_delete(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted orders stay, with their own status."""
    x = orders.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return x.withColumn("statut", F.when(F.col("_gone"), "supprimee").otherwise(F.col("statut"))).drop("_gone")


def repair_source(orders: DataFrame) -> DataFrame:
    """Orders whose subject names WhatsApp came by it."""
    wrong = F.col("email_subject").ilike("%WhatsApp%") & (F.col("source").isNull() | (F.col("source") != "whatsapp"))
    return orders.withColumn("source", F.when(F.coalesce(wrong, F.lit(False)), "whatsapp").otherwise(F.col("source")))


def backfill_phones(clients: DataFrame) -> DataFrame:
    """A missing phone is taken from a name that holds one."""
    found = F.when(F.contains("nom", F.lit("+")), T.phone_tail(F.col("nom")))
    return clients.withColumn("telephone", F.coalesce(F.nullif(F.col("telephone"), F.lit("")), found))


def rename_by_phone(clients: DataFrame, names: DataFrame) -> DataFrame:
    """Generic names are replaced by names (telephone, real_name); of several for one phone the least is taken."""
    x = clients.join(names.filter("telephone is not null").groupBy("telephone").agg(F.min("real_name").alias("real_name")), "telephone", "left")
    return x.withColumn("nom", F.when(T.generic_name(F.col("nom")), F.coalesce("real_name", "nom")).otherwise(F.col("nom"))).drop("real_name")


def remove(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def assign_codes(d: Domain) -> DataFrame:
    """id, code, status of the orders without a code: from paper, grammage and width where any of them is given, else from
    what the order and its product say in words. A code of two letters counts as failed."""
    c = F.col
    missing = with_product(Domain(d.clients, d.produits, _with(d.commandes.filter(T.blank(c("code_article"))), "type_papier")))
    given = ~T.blank(c("type_papier")) | (F.coalesce("grammage", F.lit(0)) != 0) | (F.coalesce("laize", F.lit(0)) != 0)
    said = F.concat(F.coalesce("nature_produit", F.lit("None")), F.lit(" "), F.coalesce("produit_type", F.lit("None")))
    code = F.when(given, codes.article_code(c("type_papier"), c("grammage"), c("laize"), F.lit(None).cast("string"))).otherwise(codes.suggested_code(said))
    good = F.length(code) > 2
    return missing.select("id", F.when(good, code).alias("code"), F.when(good, "success").otherwise("failed").alias("status"))


def code_counts(assigned: DataFrame) -> DataFrame:
    """generated, failed, total_processed of assign_codes."""
    good = F.count(F.when(F.col("status") == "success", 1))
    return assigned.agg(good.alias("generated"), (F.count("*") - good).alias("failed"), F.count("*").alias("total_processed"))


def code_results(assigned: DataFrame, n: int = 50) -> DataFrame:
    """The first n results, by id."""
    return assigned.orderBy("id").limit(n)


def audit(action: str, table: str, ids: DataFrame, details: str) -> DataFrame:
    """Log rows for a change, to append."""
    return ids.select(F.lit(action).alias("action"), F.lit(table).alias("table_name"), F.col("id").alias("record_id"), F.lit(details).alias("details"))
