"""Column-level functions: each returns a native Spark ``Column`` (no UDFs)."""
