"""Column functions over vectors held as arrays of doubles."""
