"""roadgeo: a Spark-native analytics engine for linear-referenced networks."""
