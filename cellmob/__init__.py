"""Analysis of mobile-network events on Spark: movement, arrivals, crowds."""
