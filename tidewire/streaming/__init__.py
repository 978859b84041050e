"""Structured Streaming: sources, rollups, stateful decoding and rules, sinks."""
