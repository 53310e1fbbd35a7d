"""Spark-first analytics over provenance-preserving media catalogs."""
