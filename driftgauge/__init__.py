"""driftgauge: measuring how a predictor behaves when its data shifts, on Spark tables."""
