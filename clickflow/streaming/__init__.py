"""Structured Streaming: incremental refresh of the daily purchase roll-up."""
