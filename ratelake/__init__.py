"""ratelake: an analytical store of keyed daily series, as Spark DataFrame operators."""
