"""Readers for slow logs, packet captures, capture files and run reports."""
