"""Relational operators over events, outcomes, runs and pairs of runs."""
