"""Streams of queries against an index that is at rest."""

from lodeseek.streaming.search import answer_stream

__all__ = ["answer_stream"]
