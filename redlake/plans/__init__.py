"""Change tracking: plans."""
