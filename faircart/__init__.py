"""Unit-price analytics as PySpark DataFrame operators."""
