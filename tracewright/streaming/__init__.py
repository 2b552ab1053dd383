"""Structured Streaming over a growing event table; beyond batch analysis."""
