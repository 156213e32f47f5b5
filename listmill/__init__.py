"""listmill: collect, classify, dedup, merge, review and export listings on Spark."""
