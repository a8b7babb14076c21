"""Structured Streaming: readings that are followed as their files arrive."""
