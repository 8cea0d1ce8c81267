"""The queries as SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions.codes import GRAMMAGE_PATTERNS, GRAMMAGES, PAPERS, SUPPLIERS, WIDTH_PATTERNS, WIDTHS
from ..functions.text import REORDER_PHRASES
from ..sources.bridge import BRIDGE_SQL, COLUMNS

NOW = "TIMESTAMP '2001-08-01 00:00:00'"
TODAY = "DATE '2001-08-01'"
_CHANNEL = "coalesce(source, 'email')"
_CLIENT_TOTALS = "SELECT client_id, count(*) AS order_count, sum(quantite) AS q, sum(prix_total) AS r FROM commandes GROUP BY client_id"
_AGE = f"date_diff('second', created_at, {NOW}) / 3600.0"


def _rate(part: str, whole: str = "count(*)", digits: int = 1) -> str:
    """A percentage, half to even on the exact value."""
    return f"format('{{:.{digits}f}}', ({part})::DOUBLE / {whole} * 100)::DOUBLE"


_PHRASES = " OR ".join(f"contains(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in REORDER_PHRASES)
_FAVOURITES = """SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY order_count DESC, newest DESC, newest_id DESC)::INTEGER AS rank FROM (
  SELECT client_id, produit_id, count(*) AS order_count, max(created_at) AS newest, arg_max(id, (created_at, id)) AS newest_id
  FROM commandes WHERE client_id IS NOT NULL AND produit_id IS NOT NULL GROUP BY 1, 2)"""
_GAPS = """SELECT client_id, round(avg(gap), 4) AS frequency FROM (
  SELECT client_id, datesub('day', lag(created_at) OVER (PARTITION BY client_id ORDER BY created_at, id), created_at) AS gap FROM commandes)
  WHERE gap IS NOT NULL GROUP BY 1"""
_TYPICAL = """SELECT client_id, type AS produit_type, nature_produit, quantite, unite FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) AS n FROM commandes WHERE statut = 'validee') t
  LEFT JOIN (SELECT id AS pid, type FROM produits) ON pid = produit_id WHERE n = 1"""
_REFERENCE = """SELECT client_id, r.id AS order_id, statut, created_at, numero_commande, type AS type_produit, nature_produit, quantite, unite, prix_unitaire, prix_total, devise FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY statut = 'validee' DESC, CASE WHEN statut = 'validee' THEN validated_at END DESC NULLS LAST, created_at DESC, id DESC) AS n FROM commandes) r
  LEFT JOIN (SELECT id AS pid, type FROM produits) ON pid = produit_id WHERE n = 1"""
_PROFILE = f"""SELECT s.*, f.frequency, t.produit_type AS typical_product, t.quantite AS typical_quantity FROM (
  SELECT client_id, count(*) AS total_orders, min(created_at) AS first_order, max(created_at) AS last_order,
    round(coalesce(avg(nullif(quantite, 0)), 0), 4) AS average_quantity, round(coalesce(sum(prix_total), 0), 2) AS total_spent
  FROM commandes GROUP BY client_id) s
  LEFT JOIN ({_GAPS}) f USING (client_id) LEFT JOIN ({_TYPICAL}) t USING (client_id)"""
_ALERTS = f"""SELECT a.type, a.severity, a.message, order_id FROM (
  SELECT id AS order_id, unnest([
    CASE WHEN email_subject ILIKE '%urgent%' OR informations_supplementaires ILIKE '%urgent%' THEN {{'type': 'urgent', 'severity': 'high', 'message': 'Commande urgente en attente: ' || coalesce(numero_commande, 'N/A') || ' - ' || who}} END,
    CASE WHEN quantite > 200 THEN {{'type': 'high_quantity', 'severity': 'medium', 'message': 'Commande avec grande quantité (' || quantite || '): ' || who}} END,
    CASE WHEN age > 24 THEN {{'type': 'pending_too_long', 'severity': 'medium', 'message': 'Commande en attente depuis ' || trunc(age)::BIGINT || 'h: ' || who}} END,
    CASE WHEN quantite > 100 AND n <= 3 THEN {{'type': 'suspicious', 'severity': 'high', 'message': '⚠️ Nouveau client avec grande commande: ' || who || ' (' || quantite || ' unités)'}} END,
    CASE WHEN confiance < 60 THEN {{'type': 'low_confidence', 'severity': 'medium', 'message': 'Commande avec faible confiance (' || confiance || '%): ' || who}} END]) AS a
  FROM (SELECT c.*, coalesce(nom, 'None') AS who, {_AGE} AS age, (SELECT count(*) FROM commandes x WHERE x.client_id = c.client_id) AS n
    FROM commandes c LEFT JOIN (SELECT id AS cid, nom FROM clients) ON cid = client_id WHERE statut = 'en_attente'))
  WHERE a IS NOT NULL"""
_INCOMING = """SELECT id AS row, CASE WHEN id % 2 = 0 THEN numero_commande ELSE 'NEW-' || (id % 500) END AS numero_commande,
  CASE WHEN id % 3 = 0 THEN email_id ELSE 'new-' || (id % 500) END AS email_id, CASE id % 4 WHEN 3 THEN 'Société ' || (id % 7) WHEN 2 THEN ' ' END AS entreprise_cliente,
  CASE WHEN id % 4 <> 1 THEN 's' || (id % 500) || '@example.com' END AS email_from, CASE WHEN id % 4 = 1 THEN '+2126' || lpad((id % 500 * 4)::VARCHAR, 8, '0') END AS phone,
  quantite, quantite_livree, devise FROM commandes"""
_NEW = f"""SELECT * FROM (
  SELECT *, CASE WHEN email_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY email_id ORDER BY row) END AS m FROM (
    SELECT *, CASE WHEN numero_commande IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY numero_commande ORDER BY row) END AS n
    FROM ({_INCOMING}) i
    WHERE NOT EXISTS (SELECT 1 FROM commandes c WHERE c.numero_commande = i.numero_commande) AND NOT EXISTS (SELECT 1 FROM commandes c WHERE c.email_id = i.email_id))
  WHERE n = 1) WHERE m = 1"""
_TEXT = """SELECT id, paper, grammage, laize, 'Sachets ' || paper || ' ' || coalesce(grammage, 90) || 'g laize ' || coalesce(laize, 25) AS description FROM (
  SELECT *, CASE id % 3 WHEN 0 THEN 'kraft blanchi' WHEN 1 THEN 'Kraft écru mondi' ELSE 'sachet' END AS paper FROM commandes)"""


def _code(paper: str) -> str:
    cases = " ".join(f"WHEN contains({paper}, '{name}') THEN '{code}'" for name, code in PAPERS)
    return f"CASE {cases} ELSE 'KE' END"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


_EXTRACTED = """SELECT id AS row, client_id, CASE WHEN id % 3 = 0 THEN 'Sacs' END AS type_produit, CASE WHEN id % 2 = 0 THEN '' ELSE nature_produit END AS nature_produit, CASE WHEN id % 4 = 0 THEN 0 ELSE quantite END AS quantite,
  CASE id % 3 WHEN 1 THEN 'KG' WHEN 2 THEN '' END AS unite, CASE WHEN id % 2 = 0 THEN prix_unitaire END AS prix_unitaire, CASE WHEN id % 5 <> 0 THEN prix_total END AS prix_total, CASE WHEN id % 4 = 1 THEN devise END AS devise,
  CASE WHEN id % 3 = 0 THEN 'vite' END AS informations_supplementaires, confiance FROM commandes"""
_FIELDS = {"type_produit": "''", "nature_produit": "''", "quantite": "0", "unite": "''", "prix_unitaire": "0", "prix_total": "0", "devise": "''"}
_TAKES = ", ".join(f"coalesce((x.{f} IS NULL OR x.{f} = {none}) AND r.{f} <> {none}, false) AS t_{f}" for f, none in _FIELDS.items())
_ANY = " OR ".join(f"t_{f}" for f in _FIELDS)
_NAMES = ", ".join(f"CASE WHEN t_{f} THEN '{f}' END" for f in _FIELDS)
_FILLED = f"""SELECT row, {", ".join(f"CASE WHEN t_{f} THEN r_{f} ELSE x_{f} END AS {f}" for f in _FIELDS)}, concat_ws(',', {_NAMES}) AS history_fields, CASE WHEN {_ANY} THEN src END AS history_source_order,
  CASE WHEN {_ANY} THEN '[AUTO-REMPLI depuis historique: ' || concat_ws(', ', {_NAMES}) || '] ' || coalesce(info, '') ELSE info END AS informations_supplementaires, (CASE WHEN {_ANY} THEN greatest(confiance, 85) ELSE confiance END)::BIGINT AS confiance
  FROM (SELECT row, confiance, x.informations_supplementaires AS info, coalesce(numero_commande, 'ID-' || order_id) AS src, {", ".join(f"x.{f} AS x_{f}, r.{f} AS r_{f}" for f in _FIELDS)}, {_TAKES}
    FROM ({_EXTRACTED}) x LEFT JOIN ({_REFERENCE}) r USING (client_id))"""
_UNCODED = """SELECT id, code_article, produit_id, CASE WHEN id % 3 <> 2 THEN type_papier END AS type_papier, CASE WHEN id % 3 <> 2 THEN grammage END AS grammage, CASE WHEN id % 3 <> 2 THEN laize END AS laize,
  CASE WHEN id % 3 <> 2 THEN nature_produit WHEN id % 5 <> 0 THEN 'Sachets ' || CASE WHEN id % 2 = 0 THEN 'kraft blanchi ' ELSE 'papier ' END || (40 + id % 7 * 10) || 'g laize ' || (id % 50) || CASE WHEN id % 4 = 0 THEN ' mondi' ELSE '' END END AS nature_produit FROM commandes"""
_FOUND = lambda patterns: "coalesce(" + ", ".join(f"nullif(regexp_extract(said, '{p}', 1), '')" for p in patterns) + ")::BIGINT"
_SUPPLIER = "CASE " + " ".join(f"WHEN contains(said, '{name}') THEN '{code}'" for name, code in SUPPLIERS) + " ELSE '' END"
_CODES = f"""SELECT id, CASE WHEN given THEN {_code("coalesce(lower(type_papier), '')")} || coalesce(nullif(grammage, 0), 80) || coalesce('L' || nullif(laize, 0), '')
    ELSE {_code("said")} || coalesce(nullif({_FOUND(GRAMMAGE_PATTERNS)}, 0), 80) || coalesce('L' || nullif({_FOUND(WIDTH_PATTERNS)}, 0), '') || {_SUPPLIER} END AS code, 'success' AS status
  FROM (SELECT u.*, coalesce(type_papier, '') <> '' OR coalesce(grammage, 0) <> 0 OR coalesce(laize, 0) <> 0 AS given, lower(coalesce(nature_produit, 'None') || ' ' || coalesce(p.type, 'None')) AS said
    FROM ({_UNCODED}) u LEFT JOIN produits p ON p.id = produit_id WHERE code_article IS NULL OR code_article = '')"""
_FLAT_SQL = """c.id, numero_commande, 1 AS ligne_commande, 'SXP' AS site_vente, 'CL' || CASE WHEN client_id >= 10000 THEN client_id::VARCHAR ELSE lpad(client_id::VARCHAR, 5, '0') END AS code_client, nom AS client, code_article, type AS produit, nature_produit,
  quantite, unite, quantite_livree, reste_a_livrer, 0.0::DOUBLE AS quantite_facturee, prix_unitaire, prix_total, devise, NULL::VARCHAR AS date_commande, NULL::VARCHAR AS date_livraison, 'DIVERS' AS commercial, NULL::VARCHAR AS type_sac, NULL::VARCHAR AS format_sac,
  type_papier, grammage, laize, NULL::VARCHAR AS impression_client, statut, confiance, source, created_at"""
_FLAT = f"SELECT {_FLAT_SQL} FROM commandes c LEFT JOIN clients cl ON cl.id = client_id LEFT JOIN produits p ON p.id = produit_id"
_BACKUPS = """SELECT strftime(TIMESTAMP '2001-01-01 00:00:00' + to_minutes(id), 'backup_%Y%m%d_%H%M%S') || CASE WHEN id % 3 = 0 THEN '.db.gz' ELSE '.db' END AS filename, id * 70000 AS size, TIMESTAMP '2001-01-01 00:00:00' + to_minutes(id) AS created FROM clients"""
_SIZE = "CASE WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END"

_DOMAIN: dict[str, str] = {
    "a1_stats": f"""SELECT count(*) AS total_orders, count_if(statut = 'en_attente')::BIGINT AS pending_orders, count_if(statut = 'validee')::BIGINT AS validated_orders,
      count_if(statut = 'rejetee')::BIGINT AS rejected_orders,
      count_if({_CHANNEL} = 'whatsapp')::BIGINT AS whatsapp_orders, count_if({_CHANNEL} = 'whatsapp' AND statut = 'en_attente')::BIGINT AS whatsapp_pending,
      count_if({_CHANNEL} = 'whatsapp' AND statut = 'validee')::BIGINT AS whatsapp_validated,
      count_if({_CHANNEL} = 'email')::BIGINT AS email_orders, count_if({_CHANNEL} = 'email' AND statut = 'en_attente')::BIGINT AS email_pending,
      count_if({_CHANNEL} = 'email' AND statut = 'validee')::BIGINT AS email_validated, (SELECT count(*) FROM clients) AS total_clients FROM commandes""",
    "a2_clients_with_orders": "SELECT cl.id, cl.nom, cl.email, cl.telephone, count(c.id) AS order_count, max(c.created_at) AS last_order FROM clients cl LEFT JOIN commandes c ON c.client_id = cl.id GROUP BY ALL",
    "a3_top_clients": f"SELECT client_id, nom, order_count, round(q, 2) AS total_quantity FROM ({_CLIENT_TOTALS}) JOIN clients ON id = client_id ORDER BY order_count DESC, q DESC NULLS LAST, client_id LIMIT 5",
    "a4_top_products": "SELECT type, count(*) AS order_count FROM commandes c JOIN produits p ON p.id = c.produit_id GROUP BY type, p.id ORDER BY 2 DESC, p.id LIMIT 5",
    "a6_revenue": "SELECT round(coalesce(sum(prix_total), 0), 2) AS total_revenue, round(coalesce(avg(prix_total), 0), 4) AS avg_order_value FROM commandes",
    "a7_quantity": "SELECT round(coalesce(sum(quantite), 0), 2) AS total_quantity, round(coalesce(avg(quantite), 0), 4) AS avg_quantity FROM commandes",
    "a8_orders_by_product": "SELECT p.type AS produit_type, count(*) AS order_count, round(sum(quantite), 2) AS total_quantity FROM commandes c LEFT JOIN produits p ON p.id = c.produit_id GROUP BY 1",
    "a9_by_status": "SELECT statut, count(*) AS order_count FROM commandes GROUP BY 1",
    "a10_top_clients_revenue": f"SELECT client_id, nom, order_count, round(r, 2) AS total_spent FROM ({_CLIENT_TOTALS}) LEFT JOIN clients ON id = client_id ORDER BY order_count DESC, client_id NULLS FIRST LIMIT 10",
    "a11_daily_30d": f"SELECT created_at::DATE AS day, count(*) AS order_count FROM commandes WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1",
    "a12_monthly": "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS order_count, round(sum(prix_total), 2) AS revenue FROM commandes GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "a13_trend": f"SELECT created_at::DATE AS day, count(*) AS order_count FROM commandes WHERE created_at >= {TODAY} - 7 GROUP BY 1",
    "a14_trend_zero_filled": f"SELECT day, strftime(day, '%d/%m') AS label, count(c.id) AS order_count FROM (SELECT unnest(generate_series({TODAY} - 6, {TODAY}, INTERVAL 1 DAY))::DATE AS day) LEFT JOIN commandes c ON c.created_at::DATE = day GROUP BY 1",
    "a15_channel_split": f"SELECT count_if({_CHANNEL} = 'whatsapp')::BIGINT AS whatsapp, count_if({_CHANNEL} = 'email')::BIGINT AS email FROM commandes",
    "a16_weekly_volume": f"SELECT created_at::DATE AS day, count(*) AS order_count, round(sum(quantite), 2) AS total_quantity FROM commandes WHERE created_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1",
    "a17_source_validation": f"""SELECT *, CASE WHEN rate >= 70 THEN 'Bon' WHEN rate >= 50 THEN 'Moyen' ELSE 'À améliorer' END AS trend FROM (
      SELECT {_CHANNEL} AS channel, count(*) AS total, count_if(statut = 'validee')::BIGINT AS validated, {_rate("count_if(statut = 'validee')")} AS rate FROM commandes GROUP BY 1)""",
    "a18_processing_hours": "SELECT round(coalesce(avg(date_diff('second', created_at, validated_at) / 3600.0::DOUBLE), 0), 4) AS avg_hours FROM commandes WHERE statut = 'validee' AND validated_at IS NOT NULL",
    "a19_product_revenue": "SELECT type AS produit_type, count(*) AS order_count, round(sum(quantite), 2) AS total_quantity, round(sum(prix_total), 2) AS revenue FROM commandes c LEFT JOIN produits p ON p.id = c.produit_id GROUP BY 1",
    "a20_segments": "SELECT CASE WHEN n >= 12 THEN 'Fidèles' WHEN n >= 6 THEN 'Réguliers' ELSE 'Nouveaux' END AS segment, count(*) AS clients FROM (SELECT count(*) AS n FROM commandes GROUP BY client_id) GROUP BY 1",
    "a21_kpis": f"""SELECT *, greatest(whatsapp_rate, 100 - whatsapp_rate) AS main_channel_share FROM (SELECT count(*) AS total, {_rate("count_if(statut = 'validee')")} AS validation_rate,
      {_rate("count_if(statut = 'rejetee')")} AS rejection_rate, {_rate(f"count_if({_CHANNEL} = 'whatsapp')")} AS whatsapp_rate FROM commandes)""",
    "a22_client_share": f"""SELECT row_number() OVER (ORDER BY order_count DESC, client_id NULLS FIRST)::INTEGER AS rank, client_id, order_count, round(coalesce(r, 0) / order_count, 2) AS avg_basket,
      round(coalesce(r, 0) * 100 / (SELECT sum(prix_total) FROM commandes), 4) AS share_pct FROM ({_CLIENT_TOTALS} ORDER BY order_count DESC, client_id NULLS FIRST LIMIT 10)""",
    "a23_erp_stats": f"""SELECT *, {_rate("with_code", "total")} AS completion_rate FROM (SELECT count(*) AS total, count_if(code_article <> '')::BIGINT AS with_code, count_if(code_article IS NULL OR code_article = '')::BIGINT AS without_code,
      count_if(statut = 'validee')::BIGINT AS validated, count_if(code_article IS NOT NULL AND grammage IS NOT NULL AND laize IS NOT NULL)::BIGINT AS complete FROM commandes)""",
    "a24_top_codes": "SELECT code_article, count(*) AS order_count FROM commandes WHERE code_article <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "a25_channel_page": f"""SELECT *, {_rate("validated", "total", 0)} AS validation_rate FROM (SELECT count(*) AS total, count_if(statut = 'en_attente')::BIGINT AS pending, count_if(statut = 'validee')::BIGINT AS validated,
      count_if(created_at::DATE = {TODAY})::BIGINT AS today, count_if(created_at::DATE >= {TODAY} - 7)::BIGINT AS week, count_if(created_at::DATE >= date_trunc('month', {TODAY}))::BIGINT AS month
      FROM commandes WHERE source = 'whatsapp' OR email_subject ILIKE 'WhatsApp%')""",
    "a26_avg_qty_nonzero": "SELECT client_id, round(coalesce(avg(nullif(quantite, 0)), 0), 4) AS average_quantity FROM commandes GROUP BY 1",
    "a27_favourites": f"SELECT client_id, produit_id, order_count, rank FROM ({_FAVOURITES}) WHERE rank <= 3",
    "a29_quantity_baseline": "SELECT round(avg(quantite), 4) AS avg_quantity, max(quantite) AS max_quantity FROM commandes",
    "a30_unit_price": "SELECT round(avg(prix_total / quantite), 4) AS avg_unit_price FROM commandes WHERE prix_total IS NOT NULL AND quantite > 0",
    "a31_newest_id": "SELECT coalesce(max(id), 0) AS last_id FROM commandes",
    "a32_table_counts": "SELECT 'clients' AS table_name, count(*) AS n FROM clients UNION ALL SELECT 'produits', count(*) FROM produits UNION ALL SELECT 'commandes', count(*) FROM commandes",
    "a33_channel_clients": "SELECT client_id, nom, count(*) AS order_count FROM commandes c JOIN clients cl ON cl.id = c.client_id WHERE source = 'whatsapp' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5",
    "a34_alerts_by_severity": f"SELECT severity, count(*) AS alerts FROM ({_ALERTS}) GROUP BY 1",
    "j1_order_detail": "SELECT c.id, cl.nom AS client_nom, cl.email AS client_email, cl.telephone AS client_telephone, p.type AS produit_type, quantite, statut FROM commandes c LEFT JOIN clients cl ON cl.id = client_id LEFT JOIN produits p ON p.id = produit_id WHERE c.id = 1",
    "j2_orders_joined": "SELECT c.id, cl.nom AS client_nom, p.type AS produit_type, statut, quantite, created_at FROM commandes c LEFT JOIN clients cl ON cl.id = client_id LEFT JOIN produits p ON p.id = produit_id",
    "j3_orders_products": "SELECT c.id, p.type AS produit_type, quantite FROM commandes c LEFT JOIN produits p ON p.id = produit_id WHERE statut = 'en_attente'",
    "j9_client_counts": "SELECT id, client_id, n AS client_orders FROM (SELECT c.*, (SELECT count(*) FROM commandes x WHERE x.client_id = c.client_id) AS n FROM commandes c) WHERE n <= 3",
    "j10_fuzzy": """SELECT search_id, client_id, nom, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, client_id) AS n FROM (
        SELECT search_id, client_id, nom, len(list_intersect(sw, cw)) / greatest(len(sw), len(cw))::DOUBLE + CASE WHEN len(list_filter(sw, lambda w: length(w) > 3 AND contains(norm, w))) > 0 THEN 0.3::DOUBLE ELSE 0 END AS score
        FROM (SELECT id AS search_id, list_distinct(string_split(replace(replace(lower('CLIENT. ' || right(nom, 9) || '-ete'), '.', ''), '-', ' '), ' ')) AS sw FROM clients) s
        JOIN (SELECT id AS client_id, 'Client ' || right(nom, 9) AS nom, lower('Client ' || right(nom, 9)) AS norm, string_split(lower('Client ' || right(nom, 9)), ' ') AS cw FROM clients) c ON len(list_intersect(sw, cw)) > 0)
      WHERE score > 0.3) WHERE n = 1""",
    "j11_processed_semi": f"SELECT row, email_id FROM ({_INCOMING}) i WHERE email_id IN (SELECT email_id FROM commandes)",
    "j12_new_orders_anti": f"SELECT row, numero_commande, email_id FROM ({_NEW})",
    "j14_product_by_name": "SELECT a.id AS row, lower(a.type[1:4]) AS wanted, min(b.id) AS produit_id FROM produits a LEFT JOIN produits b ON contains(lower(b.type), lower(a.type[1:4])) GROUP BY 1, 2",
    "w1_frequency": _GAPS,
    "w2_typical": _TYPICAL,
    "w3_first_last": "SELECT client_id, min(created_at) AS first_order, max(created_at) AS last_order FROM commandes WHERE client_id IS NOT NULL GROUP BY 1",
    "w4_last_valid": f"SELECT client_id, order_id, statut, created_at FROM ({_REFERENCE})",
    "w5_ranked": "SELECT row_number() OVER (ORDER BY revenue DESC, client_id)::INTEGER AS rank, * FROM (SELECT client_id, round(sum(prix_total), 2) AS revenue FROM commandes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)",
    "l1_recent": "SELECT c.id, nom AS client_nom, statut, created_at FROM commandes c LEFT JOIN clients cl ON cl.id = client_id ORDER BY created_at DESC NULLS LAST, c.id DESC LIMIT 20",
    "l6_last_months_ascending": "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS order_count, round(sum(prix_total), 2) AS revenue FROM commandes GROUP BY 1 ORDER BY 1 DESC LIMIT 6",
    "u1_alerts": _ALERTS,
    "t1_code_generate": f"SELECT id, {_code('lower(paper)')} || coalesce(grammage, 80) || coalesce('L' || laize, '') || CASE WHEN id % 2 = 0 THEN 'NOR' ELSE '' END AS code FROM ({_TEXT})",
    "t2_code_parse": """SELECT id, CASE m.p WHEN 'KB' THEN 'Kraft Blanchi' WHEN 'KE' THEN 'Kraft Écru' END AS paper, try_cast(nullif(m.g, '') AS BIGINT) AS grammage, try_cast(nullif(m.l, '') AS BIGINT) AS laize,
      CASE m.s WHEN 'MON' THEN 'Mondi' WHEN '' THEN NULL ELSE m.s END AS supplier
      FROM (SELECT id, regexp_extract(code_article || CASE id % 3 WHEN 0 THEN 'MON' WHEN 1 THEN 'XYZ' ELSE '' END, '^(KB|KE)?(\\d+)?(?:L(\\d+))?(.*)$', ['p', 'g', 'l', 's']) AS m FROM commandes)""",
    "t3_code_suggest": f"SELECT id, {_code('lower(description)')} || coalesce(grammage, 90) || 'L' || coalesce(laize, 25) || CASE WHEN contains(lower(description), 'mondi') THEN 'MON' ELSE '' END AS code FROM ({_TEXT})",
    "t6_bulk_codes": _CODES,
    "t8_fill_history": _FILLED,
    "t10_profile": _PROFILE,
    "t11_prediction": f"""SELECT client_id, nullif(frequency, 0)::DOUBLE // 1 AS d, average_quantity AS predicted_quantity, coalesce(l, '') AS likely_products,
      CASE WHEN total_spent > 200000 THEN 'high' WHEN total_spent > 50000 THEN 'medium' ELSE 'low' END AS client_value, trunc(nullif(frequency, 0))::BIGINT AS predicted_next_order_days FROM ({_PROFILE})
      LEFT JOIN (SELECT client_id, string_agg(type, ', ' ORDER BY rank) AS l FROM ({_FAVOURITES}) JOIN produits ON id = produit_id WHERE rank <= 3 GROUP BY 1) USING (client_id)""",
    "t12_anomalies": """SELECT order_id, type FROM (SELECT id AS order_id, unnest([CASE WHEN quantite > 3 * mq THEN 'quantity_anomaly' END,
      CASE WHEN prix_total <> 0 AND quantite <> 0 AND (prix_total / quantite < 0.3 * mp OR prix_total / quantite > 3 * mp) THEN 'price_anomaly' END]) AS type
      FROM commandes, (SELECT avg(quantite) AS mq, avg(CASE WHEN quantite > 0 THEN prix_total / quantite END) AS mp FROM commandes)) WHERE type IS NOT NULL""",
    "t13_insights": f"""SELECT insight FROM (SELECT unnest([CASE WHEN v >= 80 THEN 'validation_excellent' WHEN v >= 60 THEN 'validation_moyen' ELSE 'validation_faible' END, CASE WHEN w > 50 THEN 'whatsapp_dominant' END,
      CASE WHEN p > 5 THEN 'commandes_en_attente' END, CASE WHEN s > 30 THEN 'concentration_client' END]) AS insight FROM (
      SELECT count_if(statut = 'validee') * 100.0 / count(*) AS v, count_if({_CHANNEL} = 'whatsapp') * 100.0 / count(*) AS w, count_if(statut = 'en_attente') AS p,
        (SELECT r FROM ({_CLIENT_TOTALS}) ORDER BY order_count DESC, client_id LIMIT 1) * 100 / sum(prix_total) AS s FROM commandes)) WHERE insight IS NOT NULL""",
    "p1_by_id": "SELECT id, client_id, statut, prix_total FROM commandes WHERE id = 7",
    "p2_by_status": "SELECT id, client_id, created_at FROM commandes WHERE statut = 'en_attente'",
    "p6_preferences": f"SELECT client_id, nom, total_orders, total_spent FROM ({_PROFILE}) JOIN clients ON id = client_id WHERE nom ILIKE '%customer#000000001%'",
    "p8_urgent": "SELECT id, email_subject FROM commandes WHERE email_subject ILIKE '%urgent%' AND statut = 'en_attente'",
    "p9_high_quantity": "SELECT id, quantite FROM commandes WHERE quantite > 200 AND statut = 'en_attente'",
    "p11_stale": f"SELECT id, floor({_AGE})::BIGINT AS hours FROM commandes WHERE statut = 'en_attente' AND {_AGE} > 24 * 365",
    "p12_filtered_export": "SELECT id, statut, created_at FROM commandes WHERE statut = 'validee' AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-06-30'",
    "p13_blank": "SELECT count_if(code_article <> '')::BIGINT AS coded, count_if(code_article IS NULL OR code_article = '')::BIGINT AS blank FROM commandes",
    "p19_client_buckets": "SELECT cl.id, nom, count(c.id) AS order_count FROM clients cl LEFT JOIN commandes c ON client_id = cl.id WHERE contains(lower(nom), 'customer') OR contains(lower(email), 'customer') OR contains(telephone, 'customer') GROUP BY 1, 2 HAVING count(c.id) BETWEEN 5 AND 10",
    "f1_client_code": "SELECT id, 'CL' || CASE WHEN length((id * 97)::VARCHAR) >= 5 THEN (id * 97)::VARCHAR ELSE lpad((id * 97)::VARCHAR, 5, '0') END AS code FROM clients",
    "f2_fallback": "SELECT id, coalesce(nullif(code_article, ''), numero_commande, 'CMD-' || id) AS shown FROM commandes",
    "f4_normalized": "SELECT id, trim(replace(replace(replace(strip_accents(lower('Société M''hamid-Café. ' || nom)), '''', ''), '.', ''), '-', ' ')) AS norm FROM clients",
    "f7_phone": "SELECT id, '+' || replace(replace(replace(coalesce(telephone, '06 12 34'), 'whatsapp:', ''), '+', ''), ' ', '') AS phone, 'whatsapp:' || coalesce(telephone, '+212') AS address FROM clients",
    "f14_source": "SELECT id, coalesce(source, CASE WHEN id % 2 = 0 THEN 'whatsapp' ELSE 'email' END) AS source FROM commandes",
    "f17_shortened": "SELECT id, CASE WHEN length(nature_produit) > 10 THEN nature_produit[1:10] || '...' ELSE nature_produit END AS shown FROM commandes",
    "m1_resolve_clients": """, r0 AS (SELECT id AS row, CASE id % 4 WHEN 0 THEN upper(nom) WHEN 1 THEN 'Client WhatsApp ' || id WHEN 2 THEN 'Neuf ' || (id % 50) END AS nom, CASE WHEN id % 5 = 0 THEN email END AS email,
        CASE WHEN id % 4 = 1 THEN '+2126' || lpad((id + 3)::VARCHAR, 8, '0') END AS telephone FROM clients),
      r1 AS (SELECT row, email, telephone, coalesce(nullif(trim(nom), ''), email, telephone, 'Client Inconnu') AS nom FROM r0),
      r2 AS (SELECT *, NOT (nom LIKE 'Client WhatsApp%' OR nom LIKE 'Client Inconnu%') AS ok FROM r1),
      r3 AS (SELECT *, CASE WHEN ok THEN (SELECT min(id) FROM clients c WHERE lower(c.nom) = lower(r2.nom)) ELSE coalesce((SELECT min(id) FROM clients c WHERE c.telephone = r2.telephone), (SELECT min(id) FROM clients c WHERE c.email = r2.email)) END AS found,
        CASE WHEN ok THEN 'name:' || lower(nom) ELSE coalesce('phone:' || telephone, 'mail:' || email, 'row:' || row) END AS key FROM r2),
      r4 AS (SELECT *, CASE WHEN found IS NULL THEN min(row) OVER (PARTITION BY key, found IS NULL) END AS creator FROM r3)
      SELECT row, coalesce(found, (SELECT max(id) FROM clients) + dense_rank() OVER (PARTITION BY found IS NULL ORDER BY creator)) AS client_id, found IS NULL AND row = creator AS created FROM r4""",
    "m2_new_orders": f""", n0 AS ({_NEW}),
      n1 AS (SELECT *, coalesce(nullif(trim(entreprise_cliente), ''), 'Client WhatsApp ' || phone, email_from) AS nom, row_number() OVER (ORDER BY row) AS i FROM n0),
      n2 AS (SELECT *, nom LIKE 'Client WhatsApp%' AS generic FROM n1),
      n3 AS (SELECT *, CASE WHEN generic THEN (SELECT min(id) FROM clients c WHERE c.telephone = n2.phone) ELSE (SELECT min(id) FROM clients c WHERE lower(c.nom) = lower(n2.nom)) END AS found FROM n2),
      n4 AS (SELECT *, CASE WHEN found IS NULL THEN min(row) OVER (PARTITION BY nom, found IS NULL) END AS creator FROM n3),
      n5 AS (SELECT *, coalesce(found, (SELECT max(id) FROM clients) + dense_rank() OVER (PARTITION BY found IS NULL ORDER BY creator)) AS client_id FROM n4)
      SELECT row, (SELECT max(id) FROM commandes) + i AS id, client_id, 'CL' || CASE WHEN client_id >= 10000 THEN client_id::VARCHAR ELSE lpad(client_id::VARCHAR, 5, '0') END AS code_client,
        (SELECT min(id) FROM produits WHERE contains(lower(type), 'standard')) AS produit_id, numero_commande, 1 AS ligne_commande, 'SXP' AS site_vente, coalesce(quantite, 0) AS quantite, coalesce(quantite_livree, 0) AS quantite_livree,
        coalesce(quantite, 0) - coalesce(quantite_livree, 0) AS reste_a_livrer, 0.0::DOUBLE AS quantite_facturee, 'US' AS unite, devise, 'DIVERS' AS commercial, 'email' AS source, email_id, 'en_attente' AS statut FROM n5""",
    "m3_status_change": f"""SELECT id, CASE WHEN id % 22 = 0 THEN 'validee' WHEN id % 11 = 0 THEN 'rejetee' ELSE statut END AS statut, CASE WHEN id % 22 = 0 THEN {NOW} ELSE validated_at END AS validated_at,
      CASE WHEN id % 22 = 0 THEN 'chef' END AS validated_by, CASE WHEN id % 22 = 0 THEN 'retrait' WHEN id % 33 = 0 THEN 'prix' WHEN id % 11 = 0 THEN 'stock' WHEN statut = 'rejetee' THEN 'ancien' END AS motif_rejet FROM commandes""",
    "m4_field_change": """SELECT *, coalesce(quantite, 0) - coalesce(livree, 0) AS reste_a_livrer FROM (SELECT id, CASE WHEN id % 6 = 0 THEN coalesce(quantite + 10, quantite) ELSE quantite END AS quantite,
      CASE WHEN id % 6 = 0 THEN 77 ELSE laize END AS laize, statut, quantite_livree AS livree FROM commandes)""",
    "m5_soft_delete": "SELECT CASE WHEN statut = 'rejetee' AND quantite > 100 THEN 'supprimee' ELSE statut END AS statut, count(*) AS orders FROM commandes GROUP BY 1",
    "m6_source_repair": "SELECT id, CASE WHEN id % 8 = 0 THEN 'whatsapp' ELSE source END AS source FROM commandes",
    "m7_phone_backfill": "SELECT id, coalesce(telephone, CASE WHEN id % 2 = 0 THEN '+2127' || id END) AS telephone FROM clients",
    "m8_remove": "SELECT id, email FROM clients WHERE email IS NULL OR NOT starts_with(email, 'c1')",
    "k2_erp_export": """SELECT numero_commande, 1 AS ligne_commande, 'SXP' AS site_vente, 'CL' || CASE WHEN client_id >= 10000 THEN client_id::VARCHAR ELSE lpad(client_id::VARCHAR, 5, '0') END AS code_client, nom AS client_nom, code_article, quantite, quantite_livree,
      reste_a_livrer, 'DIVERS' AS commercial, grammage, laize, prix_total, devise, statut, confiance, source, created_at FROM commandes c LEFT JOIN clients cl ON cl.id = client_id WHERE statut = 'validee'""",
    "k1_flat_export": _FLAT,
    "k14_audit": "SELECT 'UPDATE' AS action, 'commandes' AS table_name, id AS record_id, 'Statut modifié' AS details FROM commandes",
    "l4_log_tail": "SELECT id AS record_id, 'CREATE' AS action FROM commandes ORDER BY id DESC LIMIT 50",
    "l5_clients_recent": "SELECT id, nom, order_count FROM (SELECT cl.id, nom, count(c.id) AS order_count, max(created_at) AS last_order FROM clients cl LEFT JOIN commandes c ON client_id = cl.id GROUP BY 1, 2) ORDER BY last_order DESC NULLS LAST, id",
    "n10_thousands": "SELECT id, format('{:,}', id * 1000) AS shown FROM commandes",
    "p14_routable": "SELECT count_if(contains(email, '@'))::BIGINT AS routable FROM clients",
    "p15_complete_fields": "SELECT id, code_article FROM commandes WHERE code_article IS NOT NULL AND grammage IS NOT NULL AND laize IS NOT NULL",
    "p16_generic_names": "SELECT id, id % 3 = 0 AS is_generic FROM clients",
    "t5_auto_code": f"SELECT id, coalesce(nullif(code_article, ''), CASE WHEN id % 2 = 0 THEN {_code('lower(description)')} || coalesce(grammage, 90) || 'L' || coalesce(laize, 25) || CASE WHEN contains(lower(description), 'mondi') THEN 'MON' ELSE '' END ELSE {_code('lower(paper)')} || coalesce(grammage, 80) || coalesce('L' || laize, '') END) AS code FROM ({_TEXT}) JOIN (SELECT id, code_article FROM commandes) USING (id)",
    "t9_suggest_reorder": f"""SELECT row, CASE WHEN p IS NULL OR p = '' THEN coalesce(t.produit_type, p) ELSE p END AS produit_type, CASE WHEN n IS NULL OR n = '' THEN coalesce(t.nature_produit, n) ELSE n END AS nature_produit,
      CASE WHEN q IS NULL OR q = 0 THEN coalesce(t.quantite, q) ELSE q END AS quantite, CASE WHEN u IS NULL OR u = '' THEN coalesce(t.unite, u) ELSE u END AS unite, CASE WHEN t.client_id IS NOT NULL THEN 'client_history' END AS suggestion_source
      FROM (SELECT row, client_id, type_produit AS p, nature_produit AS n, quantite AS q, unite AS u FROM ({_EXTRACTED})) x LEFT JOIN ({_TYPICAL}) t USING (client_id)""",
    "k4_json_counts": """SELECT '{"id":' || id || ',"type":"' || type || '"}' AS json FROM produits""",
    "k7_retention": f"""SELECT filename, created, {_SIZE} AS shown FROM (SELECT *, row_number() OVER (ORDER BY filename DESC) AS n FROM ({_BACKUPS})) WHERE n > 10""",
}

ORACLE: dict[str, str] = {name: BRIDGE_SQL + sql for name, sql in _DOMAIN.items()} | {
    "t11_prediction": "SELECT client_id, predicted_next_order_days, predicted_quantity, likely_products, client_value FROM (" + BRIDGE_SQL + _DOMAIN["t11_prediction"] + ")",
    "m4_field_change": "SELECT id, quantite, laize, statut, reste_a_livrer FROM (" + BRIDGE_SQL + _DOMAIN["m4_field_change"] + ")",
    "u3_codes": f"SELECT p AS paper, k || g || 'L' || w AS code, g AS grammage, w AS laize FROM (VALUES {_values(PAPERS)}) a(p, k), (VALUES {_values(GRAMMAGES)}) b(g), (VALUES {_values(WIDTHS)}) c(w)",
    "t7_reorder": f"SELECT conv_id, turn, ({_PHRASES}) AS asks_again FROM (SELECT conv_id, turn, lower(coalesce(text, '') || CASE WHEN turn % 5 = 0 THEN ' Comme d''habitude' ELSE '' END) AS t FROM conversations)",
    "f10_media": """SELECT event_id, CASE WHEN n > 0 THEN (CASE WHEN contains(m, 'image') THEN 'image' WHEN regexp_matches(m, 'audio|ogg|opus|mpeg|mp3|wav|m4a|voice') THEN 'audio' WHEN regexp_matches(m, 'pdf|document') THEN 'document' ELSE 'file' END)
      WHEN event_id % 4 = 1 THEN 'text' ELSE 'unknown' END AS kind, 'ogg' AS extension FROM (SELECT event_id, event_id % 3 AS n,
      ['image/jpeg', 'audio/ogg; codecs=opus', 'video/mpeg', 'application/pdf', 'text/vcard', 'application/vnd.ms-word.document'][event_id % 6 + 1] AS m FROM events)""",
    "s6_newest_mails": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5",
    "s7_unseen": "SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id % 2 <> 0",
    "d10_time_ago": "SELECT event_id, CASE WHEN s < 60 THEN 'À l''instant' WHEN s < 3600 THEN 'Il y a ' || s // 60 || ' min' WHEN s < 86400 THEN 'Il y a ' || s // 3600 || 'h' ELSE 'Il y a ' || s // 86400 || 'j' END AS shown FROM (SELECT event_id, event_id * 37 AS s FROM events)",
    "d11_next_slot": "SELECT event_id, TIMESTAMP '2001-08-31 00:00:00' + to_hours(least((22 // (event_id % 12 + 1) + 1) * (event_id % 12 + 1), 24)::INTEGER) AS at FROM events",
    "r1_notification_stream": "SELECT event_id, event_type FROM events WHERE event_id > 100",
    "r2_dedup_stream": "SELECT DISTINCT user_id FROM events",
    "r3_daily_stream": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


_JSON = {
    "clients": "{'id': id, 'nom': nom, 'email': email, 'telephone': telephone}",
    "produits": "{'id': id, 'type': type}",
    "commandes": "{" + ", ".join(f"'{c}': {c}" for c in COLUMNS) + "}",
}
_CLIENT_COUNTS = "SELECT cl.id, nom, email, telephone, count(c.id) AS order_count FROM clients cl LEFT JOIN commandes c ON client_id = cl.id GROUP BY ALL"
_MORE: dict[str, str] = {
    "s4_catalogue_counts": "SELECT 'ordermill_clients' AS table_name, count(*) AS n FROM clients UNION ALL SELECT 'ordermill_produits', count(*) FROM produits UNION ALL SELECT 'ordermill_commandes', count(*) FROM commandes",
    "r4_alert_stream": _ALERTS,
    "r6_overdue_stream": "SELECT id, created_at AS since FROM commandes WHERE statut = 'en_attente' AND created_at + INTERVAL 24 HOUR < (SELECT max(created_at) FROM commandes)",
    "k2_erp_headers": """SELECT numero_commande AS "Numéro commande", 1 AS "Ligne commande", 'SXP' AS "Site de vente", 'CL' || CASE WHEN client_id >= 10000 THEN client_id::VARCHAR ELSE lpad(client_id::VARCHAR, 5, '0') END AS "Code client",
      nom AS "Raison sociale", code_article AS "Code article", nature_produit AS "Désignation", NULL::VARCHAR AS "Date commande", NULL::VARCHAR AS "Date livraison prévue", quantite AS "Qtée commandée US", quantite_livree AS "Qté Livrée US",
      reste_a_livrer AS "Reste à livrer US", 0.0::DOUBLE AS "Qtée facturée US", 'DIVERS' AS "Commercial", NULL::VARCHAR AS "Type SAC", NULL::VARCHAR AS "Format LAR.PRE.LON", type_papier AS "Type de papier", grammage AS "Grammage", laize AS "Laize",
      NULL::VARCHAR AS "Impression client", prix_unitaire AS "Prix unitaire", prix_total AS "Prix total", devise AS "Devise", statut AS "Statut", confiance AS "Confiance IA (%)", source AS "Source", created_at AS "Date création"
      FROM commandes c LEFT JOIN clients cl ON cl.id = client_id WHERE statut = 'validee'""",
    "k3_csv": "SELECT id, type FROM produits",
    "k4_json_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, to_json({columns})::VARCHAR AS json FROM {t}" for t, columns in _JSON.items()),
    "k5_restored": "SELECT id, nom, email, telephone FROM clients",
    "s13_shown_backups": f"SELECT filename, size, {_SIZE} AS size_formatted, strftime(created, '%d/%m/%Y %H:%M:%S') AS date, ends_with(filename, '.gz') AS compressed FROM ({_BACKUPS})",
    "t6_bulk_counts": f"SELECT count(*) AS generated, 0::BIGINT AS failed, count(*) AS total_processed FROM ({_CODES})",
    "t6_bulk_results": f"SELECT * FROM ({_CODES}) ORDER BY id LIMIT 50",
    "m2_placed": f""", n0 AS ({_NEW}), own AS (SELECT row, numero_commande, email_id, (SELECT max(id) FROM commandes) + row_number() OVER (ORDER BY row) AS new_id FROM n0)
      SELECT i.row, coalesce(own.new_id, a.id, an.new_id, b.id, bn.new_id) AS order_id, own.new_id IS NOT NULL AS created FROM ({_INCOMING}) i LEFT JOIN own ON own.row = i.row
      LEFT JOIN (SELECT numero_commande, min(id) AS id FROM commandes GROUP BY 1) a ON a.numero_commande = i.numero_commande LEFT JOIN own an ON an.numero_commande = i.numero_commande AND an.row < i.row
      LEFT JOIN (SELECT email_id, min(id) AS id FROM commandes GROUP BY 1) b ON b.email_id = i.email_id LEFT JOIN own bn ON bn.email_id = i.email_id AND bn.row < i.row""",
    "m7_rename_by_phone": "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN telephone IS NULL THEN 'Client WhatsApp ' || id ELSE 'Société ' || (id % 10) END ELSE nom END AS nom, telephone FROM clients",
    "u4_seeded": "SELECT id, type FROM produits UNION ALL SELECT 9001, 'Sachets fond plat' UNION ALL SELECT 9002, 'Sac fond carré avec poignées plates' UNION ALL SELECT 9003, 'Sac fond carré avec poignées torsadées'",
    "a35_dashboard_rates": f"""SELECT count(*) AS total, {_rate("count_if(statut = 'validee')", digits=0)}::INTEGER AS validated_pct, {_rate("count_if(code_article <> '')", digits=0)}::INTEGER AS coded_pct FROM commandes""",
    "n12_revenue_k": "SELECT strftime(created_at, '%Y-%m') AS month, format('{:.1f}', round(sum(prix_total), 2) / 1000)::DOUBLE AS revenue_k FROM commandes GROUP BY 1",
    "n3_rounded": "SELECT id, format('{:.1f}', id / 80.0::DOUBLE)::DOUBLE AS one, format('{:.0f}', id / 2.0::DOUBLE)::DOUBLE AS none FROM commandes",
    "d8_iso_times": "SELECT id, CASE WHEN id % 5 IN (0, 1, 4) THEN created_at END AS at FROM commandes",
    "d12_slices": "SELECT id, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%H:%M') AS minute, strftime(created_at, '%m-%d') AS month_day FROM commandes",
    "f6_phone_in": "SELECT id, CASE WHEN telephone IS NOT NULL THEN telephone END AS phone, coalesce(telephone, nom) AS tail FROM clients",
    "f12_file_kind": "SELECT id, ['pdf', 'image', 'text', 'other', 'text', 'image'][id % 6 + 1] AS kind FROM commandes",
    "f15_shown": "SELECT id, coalesce(numero_commande, 'CMD-' || id) AS number, CASE WHEN id % 3 = 1 THEN '2001-08-09' ELSE 'À confirmer' END AS delivery FROM commandes",
    "f15_product": "SELECT c.id, coalesce(CASE WHEN c.id % 3 <> 0 THEN type END, nature_produit, 'N/A') AS product, coalesce(quantite::BIGINT::VARCHAR, 'N/A') || coalesce(' ' || unite, '') AS amount FROM commandes c LEFT JOIN produits p ON p.id = produit_id",
    "f16_answers": "SELECT id, CASE WHEN id % 4 <> 3 THEN id % 2 = 0 END AS is_reorder, CASE WHEN id % 4 <> 3 THEN 'C' || id END AS client_name, CASE WHEN id % 4 <> 3 THEN id % 100 END AS confidence FROM commandes",
    "f18_labels": "SELECT id, CASE statut WHEN 'en_attente' THEN '⏳ Attente' WHEN 'validee' THEN '✅ Validée' ELSE '❌ Rejetée' END AS status, CASE WHEN source = 'whatsapp' THEN '📱 WhatsApp' ELSE '📧 Email' END AS channel, upper(nature_produit[1]) AS initial FROM commandes",
    "f20_headers": "SELECT id, email_subject AS subject FROM commandes",
    "f21_prompt": "SELECT id, nature_produit[1:12] AS part FROM commandes",
    "f22_mail_content": """SELECT id, md5(chr(10) || 'SUJET: ' || email_subject || chr(10) || 'DE: ' || coalesce(source, '') || chr(10) || 'DATE: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || chr(10) || 'CONTENU:' || chr(10) || coalesce(nature_produit, '') || chr(10)
      || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'CONTENU DES PIÈCES JOINTES:' || chr(10) || chr(10) || '--- a.txt ---' || chr(10) || coalesce(devise, '') || chr(10) ELSE '' END) AS content_md5 FROM commandes""",
    "p19_client_source": f"SELECT id, nom, order_count FROM ({_CLIENT_COUNTS}) WHERE telephone IS NULL OR contains(email, '@')",
    "p19_whatsapp_clients": f"SELECT id, nom, order_count FROM ({_CLIENT_COUNTS}) WHERE telephone IS NOT NULL AND order_count BETWEEN 1 AND 5",
    "l5_clients_name": f"SELECT id, nom, order_count FROM ({_CLIENT_COUNTS}) ORDER BY nom, id",
    "l5_clients_orders_desc": f"SELECT id, nom, order_count FROM ({_CLIENT_COUNTS}) ORDER BY order_count DESC, id",
    "l5_clients_orders_asc": f"SELECT id, nom, order_count FROM ({_CLIENT_COUNTS}) ORDER BY order_count, id",
}
ORACLE |= {name: BRIDGE_SQL + sql for name, sql in _MORE.items()} | {
    "s8_webhook_stream": """SELECT conv_id, turn, 'whatsapp:+212' || conv_id AS sender, '+212' || conv_id AS phone, n AS n_media, CASE WHEN n > 0 THEN 'audio' WHEN trim(t) <> '' THEN 'text' ELSE 'unknown' END AS kind,
      'WhatsApp - whatsapp:+212' || conv_id AS subject, md5(CASE WHEN t <> '' THEN 'Message: ' || t ELSE '' END) AS content_md5 FROM (SELECT conv_id, turn, coalesce(text, '') AS t, (CASE WHEN turn % 3 = 2 THEN 0 ELSE turn % 3 END)::INTEGER AS n FROM conversations)""",
    "k8_history": "SELECT 'backup_2001080' || i || '_000000.db' AS filename, 1000 * i AS size, '2001-08-0' || i || 'T00:00:00' AS date, 'orders.db' AS db_path FROM range(1, 4) t(i)",
    "a36_unread": "SELECT count(*) AS unread FROM events WHERE event_id % 3 = 0 OR event_id % 2 <> 0",
}
