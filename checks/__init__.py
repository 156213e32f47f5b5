"""Check inputs and independent SQL for every registered query."""
