"""Operators for training text: overlaps, leaks, look-alikes, mixing and residue. Nothing else in the library imports this."""
