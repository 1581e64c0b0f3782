"""Evidence analytics on Spark: profiling, catalogs, retrieval, ledgers and governance."""
