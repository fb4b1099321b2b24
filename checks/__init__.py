"""Checking the engine on given tables: adapters, registered queries and their SQL."""
