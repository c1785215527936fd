"""Operators that prepare training data: one module an operator, and ``catalog`` with their queries."""
