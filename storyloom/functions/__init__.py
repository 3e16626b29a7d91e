"""Column functions over narrative text."""
