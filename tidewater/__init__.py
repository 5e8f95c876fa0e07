"""Tidewater: ingest, maintain and search a large catalogue of key-addressed items on Spark."""
