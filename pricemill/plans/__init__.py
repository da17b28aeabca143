"""End-to-end plans made from the operators."""
