"""Capture and metadata sources."""
