"""Order analytics on Spark: purchase-order KPIs, profiles, alerts, codes, ingest and exports as DataFrame plans."""
