"""Structured Streaming sources and sinks around the masking projection."""

from maskframe.streaming.mask_stream import (
    foreach_batch_sink, mask_stream, read_stream, write_available,
)

__all__ = ["foreach_batch_sink", "mask_stream", "read_stream", "write_available"]
