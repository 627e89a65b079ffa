"""Tessera: a Spark-first engine for versioned, searchable document collections."""
