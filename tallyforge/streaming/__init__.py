"""The online operators, on Structured Streaming."""
