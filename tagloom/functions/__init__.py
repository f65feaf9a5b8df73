"""Column functions on captions and other texts."""
