"""Rate-panel analytics on Spark: features, targets, stacking, scoring."""
