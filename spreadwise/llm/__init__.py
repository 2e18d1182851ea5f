"""Training-data operators (dedup, tokenizers, scoring, filtering) as Spark jobs."""
