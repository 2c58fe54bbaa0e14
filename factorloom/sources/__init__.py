"""Matrix files as tables."""
