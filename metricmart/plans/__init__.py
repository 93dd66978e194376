"""Catalog tables, ingest, maintenance, registered queries and their oracle SQL."""
