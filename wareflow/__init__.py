"""Batch preparation of marketplace listings on Spark: item steps, verdicts, stage runner and control plane."""
