"""Data changes, feature gates and planning."""
