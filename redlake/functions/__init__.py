"""Change tracking: functions."""
