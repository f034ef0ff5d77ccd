"""Scalar functions: built-in expressions where Spark has them, Arrow-batched functions where it doesn't."""
