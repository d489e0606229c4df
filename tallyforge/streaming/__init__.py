"""Streams of probe runs: an extension, as the survey names no stream."""
