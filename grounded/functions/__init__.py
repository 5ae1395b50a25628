"""Spark Column functions (JVM side) and NumPy helpers used inside tasks."""
