"""Change tracking: streaming."""
