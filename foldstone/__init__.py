"""Keyed-state analytics on Spark: folds, timers, expiry, snapshots, rescale."""
