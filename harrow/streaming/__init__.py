"""The same dataflows as micro-batches."""
