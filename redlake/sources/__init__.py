"""Change tracking: sources."""
