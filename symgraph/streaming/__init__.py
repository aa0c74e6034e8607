"""Changes that arrive as a stream."""
