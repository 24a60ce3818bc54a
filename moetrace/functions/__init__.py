"""Scalar functions of the engine, as columns."""
