"""Markdown document analytics on Spark."""
