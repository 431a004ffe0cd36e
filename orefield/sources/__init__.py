"""Sources of the knowledge-graph engine."""
