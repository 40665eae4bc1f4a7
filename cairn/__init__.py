"""Record-graph analytics on Spark."""
