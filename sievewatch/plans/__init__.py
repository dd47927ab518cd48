"""Runnable queries over the driver tables."""
