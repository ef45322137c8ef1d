"""Column-level building blocks: Column in, Column out, native expressions only."""
