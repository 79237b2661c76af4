"""Registered queries and the DuckDB SQL that says the same."""
