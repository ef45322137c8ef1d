"""DataFrame-level operators, grouped by family."""
