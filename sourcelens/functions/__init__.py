"""Column builders and driver-side functions."""
