"""Column functions: geometry of boxes and statistics of text."""
