"""Incremental scoring of arriving files with a fitted classifier."""

from tessera.streaming.scoring import score_stream

__all__ = ["score_stream"]
