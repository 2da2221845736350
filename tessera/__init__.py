"""Entity resolution on Spark: retrieval, pair features, ownership, decoding and evaluation as DataFrame plans."""
