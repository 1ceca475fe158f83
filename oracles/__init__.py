"""Independent SQL for the correctness gate."""
