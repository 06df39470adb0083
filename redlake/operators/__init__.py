"""Change tracking: operators."""
