"""Training-data operators. Nothing outside this folder imports them but ``__spark_entry__`` and ``corpus_pipeline``."""
