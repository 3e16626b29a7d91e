"""The graph as tables, and its binding to the driver's tables."""
