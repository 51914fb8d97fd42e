"""Column-level functions: window primitives, indicators and stable features."""
