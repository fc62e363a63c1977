"""Chunk plans."""

from .chunks import balanced, chunk_frame, chunk_of, chunks, file_waves, first_key, grouped, n_chunks, waves

__all__ = ["balanced", "chunk_frame", "chunk_of", "chunks", "file_waves", "first_key", "grouped", "n_chunks", "waves"]
