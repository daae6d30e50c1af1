"""Answers that arrive over time, folded into the pool with Structured Streaming.

The published workflow has no streaming; its annotator is simulated inside
the flip. Here the flip stays :func:`labelpool.operators.labels.apply_labels`
and this package only drives it from a stream of answer files.
"""

from labelpool.streaming.arrivals import answers_stream, pool_with_answers, start_answer_sink

__all__ = ["answers_stream", "pool_with_answers", "start_answer_sink"]
