"""Change feeds and keyed last-write-wins as Structured Streaming queries."""
