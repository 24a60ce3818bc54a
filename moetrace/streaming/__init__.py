"""The engine's folds over streams of accesses: an addition of this engine, with state kept by Structured Streaming."""
