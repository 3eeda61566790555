"""Reading and writing captures."""
