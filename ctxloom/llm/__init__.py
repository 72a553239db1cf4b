"""Operators that prepare training data at scale. Nothing outside this folder imports them."""
