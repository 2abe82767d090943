"""Registered queries: one (spark, sf_dir) -> DataFrame per operator, with the same question as DuckDB SQL."""
