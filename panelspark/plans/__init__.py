"""Registered queries: every operator run over the driver tables, with its DuckDB twin where SQL can say it."""
