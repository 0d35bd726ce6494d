"""Operators that prepare training data for language models. Nothing else here imports them."""
