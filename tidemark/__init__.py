"""A change-data-capture mirror on Spark: feed in, versioned table out, proofs included."""
