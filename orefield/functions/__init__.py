"""Functions of the knowledge-graph engine."""
