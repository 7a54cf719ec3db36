"""edgeloom: dependency-graph analytics on Spark."""
