"""Where the round-trip queries write."""

from burnish.sources.scratch import scratch_dir

__all__ = ["scratch_dir"]
