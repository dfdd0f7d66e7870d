"""Column expressions, and the few UDFs that built-in functions cannot replace."""
