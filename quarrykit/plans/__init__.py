"""Adapters over the test tables and the catalogue of named queries with their SQL."""
