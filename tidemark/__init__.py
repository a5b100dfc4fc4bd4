"""Entity-by-date panel analytics on PySpark: ingest, membership, daily state, features, factor reports."""
