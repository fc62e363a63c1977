"""Structured Streaming."""

from .follow import follow_files

__all__ = ["follow_files"]
