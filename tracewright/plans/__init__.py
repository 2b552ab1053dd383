"""Whole workflows: replay, reports, rendering and the command line."""
