"""Contest analytics on Spark: history features, ratings, markets, ledgers and model evaluation."""
