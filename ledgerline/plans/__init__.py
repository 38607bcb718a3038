"""Products composed from the operators."""
