"""Streaming forms of event-time operators; each has a batch form that gives the same rows over the same input."""
