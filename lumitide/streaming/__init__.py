"""Live variants of operators, for Structured Streaming."""
