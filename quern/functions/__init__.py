"""Scalar building blocks, gathered from the operators that define them."""

from quern.operators.similarity import coefficients
from quern.operators.sketches import hashed, key_number, multiplier, offset, trailing_zeros

__all__ = ["coefficients", "hashed", "key_number", "multiplier", "offset", "trailing_zeros"]
