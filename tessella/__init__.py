"""Note-corpus analytics on Spark: indexing, ranked retrieval, data-quality rules, neighbour joins, lifecycle, evaluation."""
