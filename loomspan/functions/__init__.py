"""Scalar functions as Column expressions, with Arrow UDFs where bytes need them."""
