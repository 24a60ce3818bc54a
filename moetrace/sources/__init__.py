"""Relations of the engine, derived from stored tables."""
