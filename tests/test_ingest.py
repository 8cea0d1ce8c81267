"""Batch ingest against plain Python loops that take one row after the other."""

from __future__ import annotations

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from ordermill.functions import numbers
from ordermill.functions import text as T
from ordermill.operators import export, inbox, ingest, joins, metrics
from ordermill.sources.bridge import Domain

CLIENTS = "id long, nom string, email string, telephone string"
REQUESTS = "row long, nom string, email string, telephone string"


def one_by_one(clients, requests):
    """The clients after a batch, and each request's client."""
    table, out = [list(c) for c in clients], []
    for row, nom, email, phone in sorted(requests):
        if not nom or not nom.strip():
            nom = email or phone or "Client Inconnu"
        found = None
        if not nom.startswith(("Client WhatsApp", "Client Inconnu")):
            found = next((c for c in table if c[1].lower() == nom.lower()), None)
            if found and phone and not found[3]:
                found[3] = phone
        else:
            if phone:
                found = next((c for c in table if c[3] == phone), None)
            if found is None and email:
                found = next((c for c in table if c[2] == email), None)
        created = found is None
        if created:
            found = [max([0, *(c[0] for c in table)]) + 1, nom, email, phone]
            table.append(found)
        out.append((row, found[0], created))
    return [tuple(c) for c in table], out


@pytest.mark.parametrize("seed", range(6))
def test_clients_are_resolved_one_by_one(spark, seed):
    rng = random.Random(seed)
    names, phones, mails = ["Atlas", "atlas", "Neuf", "Bab", "Client WhatsApp", "Client WhatsApp 7", "Client Inconnu", "", None, "  "], [None, "", "+1", "+2", "+3", "+4"], [None, "", "a@a", "b@b", "c@c"]
    clients = [(i + 1, n, rng.choice(mails), rng.choice(phones)) for i, n in enumerate(rng.sample(["Atlas", "Zed", "Client WhatsApp 1", "Bab"], rng.randint(0, 4)))]
    requests = [(i * 3 + 5, rng.choice(names), rng.choice(mails), rng.choice(phones)) for i in range(60)]
    table, want = one_by_one(clients, requests)
    c, r = spark.createDataFrame(clients, CLIENTS), spark.createDataFrame(requests, REQUESTS)
    got = sorted((x["row"], x["client_id"], x["created"]) for x in ingest.resolve_clients(c, r).collect())
    assert got == want
    after = {x["id"]: (x["nom"], x["email"], x["telephone"]) for x in ingest.clients_after(c, r).collect()}
    assert after == {i: tuple(rest) for i, *rest in table}


def test_the_cases_where_names_phones_and_mails_meet(spark):
    clients = [(1, "Atlas", "a@x", None)]
    batch = [(1, "Neuf", None, "+1"), (2, "Client WhatsApp", None, "+1"), (3, "ATLAS", None, "+9"), (4, "Client WhatsApp 7", None, "+9"), (5, "Client WhatsApp", "m@m", "+5"), (6, "Client Inconnu", "m@m", None)]
    got = {x["row"]: x["client_id"] for x in ingest.resolve_clients(spark.createDataFrame(clients, CLIENTS), spark.createDataFrame(batch, REQUESTS)).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1, 5: 3, 6: 3}


@pytest.mark.parametrize("seed", range(4))
def test_orders_are_taken_one_by_one(spark, seed):
    rng = random.Random(seed)
    pick = lambda k: rng.choice([None, "", *(f"{k}{i}" for i in range(12))])
    orders = [(1, "n1", "m1"), (2, None, "m2"), (3, "n3", None)]
    batch = [(i + 10, pick("n"), pick("m")) for i in range(80)]
    numbers_, mails, ids, want = {n: i for i, n, _ in orders if n}, {m: i for i, _, m in orders if m}, 3, []
    for row, n, m in batch:
        known = numbers_.get(n) if n else None
        known = (mails.get(m) if m else None) if known is None else known
        created = known is None
        if created:
            ids += 1
            known = ids
            if n:
                numbers_[n] = ids
            if m:
                mails[m] = ids
        want.append((row, known, created))
    o, b = spark.createDataFrame(orders, "id long, numero_commande string, email_id string"), spark.createDataFrame(batch, "row long, numero_commande string, email_id string")
    assert sorted((r["row"], r["order_id"], r["created"]) for r in ingest.placed(o, b).collect()) == want


@pytest.fixture(scope="module")
def domain(spark):
    clients = spark.createDataFrame([(1, "Atlas", "a@x", None), (2, "Société Café", None, "+2121")], CLIENTS)
    produits = spark.createDataFrame([(1, "Sachets fond plat"), (2, "Sac fond carré kraft blanchi")], "id long, type string")
    rows = [(1, 1, 1, "en_attente", None, "old reason", None, 5.0, 1.0), (2, 2, 2, "rejetee", None, "keep", None, None, None), (3, None, None, "validee", "2001-01-01 00:00:00", None, "a", 2.0, 0.0)]
    x = spark.createDataFrame(rows, "id long, client_id long, produit_id long, statut string, validated_at string, motif_rejet string, validated_by string, quantite double, quantite_livree double")
    x = x.withColumn("validated_at", F.col("validated_at").cast("timestamp_ntz"))
    return Domain(clients, produits, x)


def test_new_orders_get_client_product_and_defaults(spark, domain):
    d = Domain(domain.clients, domain.produits, spark.createDataFrame([(7, "A", "m")], "id long, numero_commande string, email_id string"))
    batch = [(1, "A", "x", "Atlas", None, None, "plat", None), (2, "B", "m", "Atlas", None, None, None, None), (3, "C", "y", " ", None, "whatsapp:+9", "sac", 4.0), (4, "D", "z", "atlas", "q@q", None, "", 2.5), (5, "D", "w", "New", None, None, None, 1.0)]
    got = {r["row"]: r for r in ingest.new_orders(d, spark.createDataFrame(batch, "row long, numero_commande string, email_id string, entreprise_cliente string, email_from string, whatsapp_from string, type_produit string, quantite double")).collect()}
    assert set(got) == {3, 4} and (got[3]["id"], got[4]["id"]) == (8, 9)
    assert (got[3]["client_id"], got[3]["code_client"], got[3]["produit_id"]) == (3, "CL00003", 1)
    assert (got[4]["client_id"], got[4]["produit_id"], got[4]["reste_a_livrer"], got[4]["unite"], got[4]["commercial"], got[4]["statut"]) == (1, None, 2.5, "US", "DIVERS", "en_attente")
    assert set(ingest.ORDER_COLUMNS) <= set(got[3].asDict()) and len(ingest.ORDER_COLUMNS) == 32


def test_changes_touch_their_orders_alone_and_follow_each_other(spark, domain):
    changes = spark.createDataFrame([(1, 1, "rejetee", None, "prix", None), (2, 1, "validee", "2001-08-01 00:00:00", None, "chef"), (3, 1, "rejetee", None, "stock", None), (4, 3, "en_attente", None, None, None), (5, 9, "validee", None, None, None)], "row long, id long, new_statut string, at string, motif string, validated_by string")
    got = {r["id"]: r for r in ingest.apply_status(domain.commandes, changes.withColumn("at", F.col("at").cast("timestamp_ntz"))).collect()}
    assert len(got) == 3
    assert (got[1]["statut"], got[1]["motif_rejet"], got[1]["validated_by"], str(got[1]["validated_at"])) == ("rejetee", "stock", "chef", "2001-08-01 00:00:00")
    assert (got[2]["statut"], got[2]["motif_rejet"]) == ("rejetee", "keep")
    assert (got[3]["statut"], got[3]["validated_by"], str(got[3]["validated_at"])) == ("en_attente", "a", "2001-01-01 00:00:00")
    fields = spark.createDataFrame([(1, 1, 50.0), (2, 1, None), (3, 1, 60.0), (4, 2, 7.0)], "row long, id long, quantite double")
    got = {r["id"]: r for r in ingest.apply_fields(domain.commandes, fields).collect()}
    assert len(got) == 3 and got[1]["quantite"] == 60.0 and got[1]["reste_a_livrer"] == 59.0 and got[2]["quantite"] == 7.0
    gone = ingest.soft_delete(domain.commandes, spark.createDataFrame([(1,), (1,)], "id long"))
    assert sorted((r["id"], r["statut"]) for r in gone.select("id", "statut").collect()) == [(1, "supprimee"), (2, "rejetee"), (3, "validee")]


def test_codes_come_from_fields_or_else_from_words(spark, domain):
    rows = [(1, None, "sachets kraft blanchi 100g laize 28 mondi", 1, None, None, None), (2, "", "x", 2, "", None, None), (3, None, "kraft blanchi", 1, "kraft ecru", 0, 25), (4, "KB", "x", 1, None, None, None), (5, None, None, None, None, 60, None), (6, None, None, None, None, None, None)]
    d = Domain(domain.clients, domain.produits, spark.createDataFrame(rows, "id long, code_article string, nature_produit string, produit_id long, type_papier string, grammage long, laize long"))
    got = {r["id"]: r["code"] for r in ingest.assign_codes(d).collect()}
    assert got == {1: "KB100L28MON", 2: "KB80", 3: "KE80L25", 5: "KE60", 6: "KE80"}
    assert ingest.code_counts(ingest.assign_codes(d)).first().asDict() == {"generated": 5, "failed": 0, "total_processed": 5}
    assert [r["id"] for r in ingest.code_results(ingest.assign_codes(d), 2).collect()] == [1, 2]


def test_catalogue_is_seeded_once(spark, domain):
    more = spark.createDataFrame([(1, "x"), (3, "Sachets fond plat"), (4, "new"), (4, "other"), (5, "new"), (6, "last")], "id long, type string")
    assert sorted(tuple(r) for r in ingest.seeded(domain.produits, more).collect()) == [(1, "Sachets fond plat"), (2, "Sac fond carré kraft blanchi"), (4, "new"), (6, "last")]


def plain_name(name):
    text = "".join(c for c in unicodedata.normalize("NFD", (name or "").lower()) if unicodedata.category(c) != "Mn")
    return text.replace("'", "").replace("-", " ").replace(".", "").strip()


def test_names_are_folded_as_unicode_says(spark):
    letters = [chr(c) for c in (*range(1, 0x3100), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D500)) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    odd = {c for c in letters if len(plain_name(c)) > 1}  # fall apart into several letters: stated in the docstring
    names = [f" {c}a{c} " for c in letters if c not in odd] + ["Société M'hamid-Café. ", " أمين ", "Nguyễn Thế", None, "", "\x1cA\x85"]
    got = spark.createDataFrame(list(enumerate(names)), "i long, name string").select("i", T.normalized_name(F.col("name")).alias("x")).collect()
    wrong = [(names[r["i"]], r["x"], plain_name(names[r["i"]])) for r in got if r["x"] != plain_name(names[r["i"]])]
    assert len(odd) < 60 and not wrong, wrong[:5]


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    values = [n / d * 100 for d in range(1, 90) for n in range(0, d + 1)] + [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [k / 20 for k in range(-400, 400)] + [0.05, 6.25, 2.35, 2.65, 1e15]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.rounded(F.col("v")).alias("a"), numbers.whole(F.col("v")).alias("b")).collect()
    assert [(r["v"], r["a"], r["b"]) for r in got if r["a"] != round(r["v"], 1) or r["b"] != round(r["v"])] == []


def best_match(search, clients):
    s, best, found = set(plain_name(search).split()), 0, None
    for i, nom in sorted(clients):
        name = plain_name(nom)
        words = set(name.split())
        if s & words:
            score = len(s & words) / max(len(s), len(words)) + (0.3 if any(w in name for w in s if len(w) > 3) else 0)
            if score > best:
                best, found = score, i
    return (found, round(best, 6)) if found and best > 0.3 else None


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_fuzzy_match_is_the_best_of_all(spark, frequent):
    """With no word, some words and all words frequent."""
    rng = random.Random(frequent)
    vocabulary = ["el", "sa", "de", "ste", "atlas", "atlasien", "maroc", "café", "cafe", "emballage", "nord", "nordest", "bab"]
    names = lambda n: [(i, rng.choice([" ", "-"]).join(rng.choices(vocabulary, k=rng.randint(0, 4)))) for i in range(1, n)]
    clients, searches = names(120), names(150)
    c = spark.createDataFrame([(i, n, None, None) for i, n in clients], CLIENTS)
    got = {r["search_id"]: (r["client_id"], round(r["score"], 6)) for r in joins.fuzzy_match(spark.createDataFrame(searches, "search_id long, search string"), c, frequent).collect()}
    assert got == {i: m for i, s in searches if (m := best_match(s, clients))}


def test_files_come_back(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.pdf").write_bytes(b"x")
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in inbox.text_files(spark, str(tmp_path)).collect()} == {"a.txt": "été", "b.csv": ""}
    assert [r["text"] for r in inbox.pdf_files(spark, str(tmp_path)).collect()] == [""]
    for name in ("backup_20010801_000000.db", "backup_20010802_000000.db.gz", "backup_x.txt", "other.db", "backup_odd.db"):
        (tmp_path / name).write_bytes(b"xx")
    listed = export.list_folder(spark, str(tmp_path))
    assert [r["filename"] for r in listed.collect()] == ["backup_odd.db", "backup_20010802_000000.db.gz", "backup_20010801_000000.db"]
    assert {r["filename"]: r["date"] for r in export.shown_backups(listed).collect()}["backup_odd.db"] == "N/A"
    x = spark.createDataFrame([(1, "é")], "id long, t string")
    export.write_csv(x.coalesce(1), str(tmp_path / "csv"), mark=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,t")
    assert export.write_if_any(x, str(tmp_path / "j")) and not export.write_if_any(x.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_mail_headers_and_unread(spark):
    x = spark.createDataFrame([("=?utf-8?b?w6l0w6k=?=",), ("plain",), (None,), ("=?nope?b?w6l0w6k=?=",)], "h string")
    assert [r[0] for r in x.select(inbox.decoded_header(F.col("h"))).collect()] == ["été", "plain", None, "=?nope?b?w6l0w6k=?="]
    assert metrics.unread(spark.createDataFrame([(True,), (False,), (None,)], "is_read boolean")).first()[0] == 2


def test_streams_restart_where_they_stopped(spark, tmp_path):
    """A schedule hands on new rows alone; a stream run again over the same checkpoint adds nothing."""
    from ordermill.streaming import feeds

    x = spark.createDataFrame([(i, i % 3 == 0) for i in range(9)], "id long, odd boolean")
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: feeds.feed(spark, str(tmp_path / "in"), x.schema)
    point = str(tmp_path / "point")
    assert feeds.run_available(feeds.notifications(stream(), 5), "n", point).count() == 3
    assert feeds.run_available(feeds.notifications(stream(), 5), "n", point).count() == 0
    seen = []
    query = feeds.every(stream(), 1, str(tmp_path / "other"), lambda batch, n: seen.append((n, batch.count())))
    until = time.monotonic() + 60
    while not seen and time.monotonic() < until:  # the next turn would be in an hour
        time.sleep(0.2)
    query.stop()
    assert seen == [(0, 9)]


def test_orders_are_overdue_once_unless_validated(spark, tmp_path):
    from ordermill.streaming import feeds

    rows = [(1, "2001-01-01 00:00:00", True), (2, "2001-01-01 00:00:00", True), (2, "2001-01-01 05:00:00", False), (3, "2001-01-03 12:00:00", True), (4, "2001-01-01 10:00:00", True), (9, "2001-01-04 00:00:00", False)]
    x = spark.createDataFrame(rows, "id long, at string, pending boolean").withColumn("at", F.col("at").cast("timestamp"))
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = feeds.run_available(feeds.overdue(feeds.feed(spark, str(tmp_path / "in"), x.schema).withWatermark("at", "0 seconds"), 24), "o", str(tmp_path / "point"))
    assert sorted((r["id"], str(r["since"])) for r in found.collect()) == [(1, "2001-01-01 00:00:00"), (4, "2001-01-01 10:00:00")]


def test_overdue_orders_share_groups_of_state(spark, tmp_path):
    """Many keys, as if their events came one by one, with exact times; Python and the state deal with groups of keys."""
    from ordermill.streaming import feeds

    start, hour = 978_307_200_000_000, 3_600_000_000  # 2001-01-01
    events = [(k if k % 100 else None, start + b * 10 * hour + (k * 7 + b) % 10 * hour + k % 1000, (k + b) % 5 != 0) for b in range(5) for k in range(1500)]
    x = spark.createDataFrame([*events, (1, None, True), (1501, None, True)], "id long, us long, pending boolean").select("id", F.timestamp_micros("us").alias("at"), "pending")
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    done = []
    found = feeds.overdue(feeds.feed(spark, str(tmp_path / "in"), x.schema).withWatermark("at", "0 seconds"), 24, groups=64)
    query = found.writeStream.trigger(availableNow=True).foreachBatch(lambda batch, n: done.extend((r["id"], r["us"]) for r in batch.select("id", F.unix_micros("since").alias("us")).collect())).start()
    query.awaitTermination()
    waiting, last = {}, max(e[1] for e in events) // 1000
    for name, at, pending in sorted(events, key=lambda e: e[1]):
        waiting.setdefault(name, at) if pending else waiting.pop(name, None)
    want = {(name, at) for name, at in waiting.items() if at + 24 * hour < last * 1000}
    assert len(want) > 400 and set(done) == want and len(done) == len(want)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 65


def test_webhook_lines_that_are_no_json(spark):
    from ordermill.streaming import feeds

    lines = spark.createDataFrame([('{"From": "whatsapp:+1", "Body": "hi", "NumMedia": "x"}',), ("not json",), (None,)], "value string")
    got = [(r["sender"], r["phone"], r["n_media"], r["kind"], r["content"]) for r in feeds.webhook_messages(lines).collect()]
    assert got == [("whatsapp:+1", "+1", 0, "text", "Message: hi"), ("N/A", "N/A", 0, "unknown", ""), ("N/A", "N/A", 0, "unknown", "")]
