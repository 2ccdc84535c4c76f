"""Structured Streaming operators (T1-T6) and a file replay source for tests."""
