"""End-to-end tables built from the operators."""
