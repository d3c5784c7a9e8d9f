"""The operators that keep state between scrapes, on Structured Streaming."""
