"""functions of the code-knowledge-graph engine."""
