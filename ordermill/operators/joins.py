"""Joins of orders with their clients and products, semi and anti joins for ingest, and fuzzy client matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from ..sources.bridge import Domain

#: A match needs more than this score; a long shared word adds this much.
LEAST_SCORE, LONG_WORD_BONUS, LONG_WORD = 0.3, 0.3, 3
#: A word that more clients have is frequent.
FREQUENT = 200


def order_view(d: Domain) -> DataFrame:
    """All orders with client and product names and contacts; orders without either are kept."""
    people = d.clients.select(F.col("id").alias("client_id"), F.col("nom").alias("client_nom"), F.col("email").alias("client_email"), F.col("telephone").alias("client_telephone"))
    kinds = d.produits.select(F.col("id").alias("produit_id"), F.col("type").alias("produit_type"))
    return d.commandes.join(people, "client_id", "left").join(kinds, "produit_id", "left")


def with_client(d: Domain) -> DataFrame:
    return d.commandes.join(d.clients.select(F.col("id").alias("client_id"), F.col("nom").alias("client_nom")), "client_id", "left")


def with_product(d: Domain) -> DataFrame:
    return d.commandes.join(d.produits.select(F.col("id").alias("produit_id"), F.col("type").alias("produit_type")), "produit_id", "left")


def client_order_counts(orders: DataFrame) -> DataFrame:
    """Each order with the number of its client's orders; 0 where the client is not known.

    Counts are aggregated first, so that neither a client with very many orders nor all orders without one are one task."""
    counts = orders.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("client_orders"))
    return orders.join(counts, "client_id", "left").withColumn("client_orders", F.coalesce("client_orders", F.lit(0)))


def processed(orders: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming messages whose email_id an order has already."""
    return incoming.join(orders.select("email_id"), "email_id", "left_semi")


def unprocessed(orders: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming orders that are new by number and by email_id, as if they came one by one in the order of row: a repeat
    of one that was taken is left out, a repeat of one that was left out is not."""
    x = incoming
    for key in ("numero_commande", "email_id"):
        x = x.join(orders.select(key).filter(~T.blank(F.col(key))), key, "left_anti")
    return x.join(first_come(x.select("row", *[F.nullif(F.col(k), F.lit("")).alias(k) for k in ("numero_commande", "email_id")]), "row", ("numero_commande", "email_id")), "row", "left_semi")


def first_come(rows: DataFrame, order: str, keys: tuple[str, ...]) -> DataFrame:
    """The column `order` of the rows that are taken when they come one by one and a row that shares a key (not null)
    with one taken before is left out.

    In each round the rows that are first in all of their keys are taken and those that share a key with these are left out.
    There are as many rounds as the longest chain of rows of which each depends on the one before, mostly two or three."""
    left, taken = cut(rows.select(order, *keys)), None
    while True:
        x = left
        for k in keys:
            first = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_{k}"))
            x = x.join(first, k, "left")
        chosen = F.lit(True)
        for k in keys:
            chosen = chosen & (F.col(k).isNull() | (F.col(f"_{k}") == F.col(order)))
        new = cut(x.filter(chosen).select(order, *keys))
        taken = new.select(order) if taken is None else taken.unionByName(new.select(order))
        left = left.join(new.select(order), order, "left_anti")
        for k in keys:
            left = left.join(new.select(k).filter(F.col(k).isNotNull()), k, "left_anti")
        left = cut(left)
        if left.isEmpty():
            return taken


def fuzzy_match(searches: DataFrame, clients: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """search_id, search, client_id, nom, score: the best client of each search, the smaller id if scores are equal.

    A score needs a common word. Words that more than `frequent` clients have would pair all with all, so these three ways
    find the best between them, and none makes more pairs than there are rows times `frequent` or times kinds of names:
    by a rarer word, each client; by a frequent word alone, the first client of each kind, which is the frequent words
    of a name and its number of words, as all of a kind then score alike; and where the frequent word is too short for the
    bonus, each client that shares it and holds the beginning of a long word of the search."""
    c = F.col
    # names are folded and split once, not in each of the ways
    named = cut(clients.select(c("id").alias("client_id"), "nom", T.normalized_name(c("nom")).alias("norm")).withColumn("theirs", T.words(c("norm")))).withColumn("n", F.size("theirs"))
    asked = cut(searches.select("search_id", "search", T.words(T.normalized_name(c("search"))).alias("ours")))
    own, wanted = named.select("client_id", F.explode("theirs").alias("word")), asked.select("search_id", F.explode("ours").alias("word"))
    hot = own.groupBy("word").agg(F.count("*").alias("_n")).filter(c("_n") > frequent).select("word")
    rare, common = own.join(hot, "word", "left_anti"), own.join(hot, "word", "left_semi")
    by_rare = wanted.join(rare, "word").select("search_id", "client_id")
    kinds = common.groupBy("client_id").agg(F.sort_array(F.collect_set("word")).alias("hot")).join(named.select("client_id", "n"), "client_id").groupBy("hot", "n").agg(F.min("client_id").alias("client_id"))
    by_kind = wanted.join(kinds.select("client_id", F.explode("hot").alias("word")), "word").select("search_id", "client_id")
    short = F.length("word") <= LONG_WORD
    starts = asked.select("search_id", F.explode(F.filter("ours", lambda w: F.length(w) > LONG_WORD)).alias("long")).select("search_id", F.left("long", F.lit(LONG_WORD + 1)).alias("gram"))
    grams = named.join(common.filter(short).select("client_id").distinct(), "client_id", "left_semi").select("client_id", F.explode("theirs").alias("w")).filter(F.length("w") > LONG_WORD)
    grams = grams.select("client_id", F.explode(F.sequence(F.lit(1), F.length("w") - LONG_WORD)).alias("i"), "w").select("client_id", F.substring(c("w"), c("i"), F.lit(LONG_WORD + 1)).alias("gram"))
    by_gram = wanted.filter(short).join(starts, "search_id").join(common.filter(short).join(grams, "client_id"), ["word", "gram"]).select("search_id", "client_id")
    x = by_rare.unionByName(by_kind).unionByName(by_gram).distinct().join(asked, "search_id").join(named, "client_id")
    shared = F.size(F.array_intersect("ours", "theirs")) / F.greatest(F.size("ours"), "n")
    long_word = F.exists("ours", lambda w: (F.length(w) > LONG_WORD) & F.contains(c("norm"), w))
    x = x.withColumn("score", shared + F.when(long_word, LONG_WORD_BONUS).otherwise(0.0)).filter(c("score") > LEAST_SCORE)
    best = x.groupBy("search_id").agg(F.max_by(F.struct("search", "client_id", "nom", "score"), F.struct("score", -c("client_id"))).alias("b"))
    return best.select("search_id", "b.*")


def product_by_name(requests: DataFrame, produits: DataFrame) -> DataFrame:
    """row, wanted, produit_id: the first product whose name holds the wanted one, in any case; null if none does.

    Distinct wanted names are looked up in the catalogue, and rows join the result by name."""
    wanted = requests.select(F.lower("wanted").alias("_w")).distinct()
    found = wanted.join(produits.select(F.col("id").alias("produit_id"), "type"), F.contains(F.lower("type"), F.col("_w"))).groupBy("_w").agg(F.min("produit_id").alias("produit_id"))
    return requests.join(found, F.lower("wanted") == F.col("_w"), "left").select("row", "wanted", "produit_id")
