"""Operators for training data: splitting, near-duplicates, defective pairs, leaks, encoding, filling, shared spans."""
