"""Column expressions, ranks and staging."""
