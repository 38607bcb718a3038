"""Column expressions, rule packs and the few Arrow functions."""
