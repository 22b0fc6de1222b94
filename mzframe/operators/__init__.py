"""Transforms of spectrum, peak, parameter and token tables."""
