"""Detection, grouping, decisions, the retroactive join, retention and metrics."""
