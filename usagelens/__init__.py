"""Usage analytics for compute clusters as Spark DataFrame operators."""
