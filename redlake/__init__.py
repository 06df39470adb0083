"""redlake: change tracking for versioned document collections, on Spark."""
