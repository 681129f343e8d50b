"""DataFrame operators: one row per document in, one row per document out."""
