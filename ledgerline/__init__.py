"""Evidence analytics over versioned public records, written for Spark."""
