"""Operators over event, edge and feature tables, and the catalogue of queries."""
