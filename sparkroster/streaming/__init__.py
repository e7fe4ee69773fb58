"""Structured Streaming operators."""

from sparkroster.streaming.changes import apply_change_stream, stream_results
from sparkroster.streaming.closing import closed_outcomes_stream
from sparkroster.streaming.outcomes import run_outcomes_stream, unstarted_outcomes_stream, write_outcomes
from sparkroster.streaming.tails import tail_lines_stream, tails_of

__all__ = [
    "apply_change_stream",
    "closed_outcomes_stream",
    "run_outcomes_stream",
    "stream_results",
    "tail_lines_stream",
    "tails_of",
    "unstarted_outcomes_stream",
    "write_outcomes",
]
