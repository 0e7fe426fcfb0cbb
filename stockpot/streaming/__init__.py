"""Structured Streaming counterparts: incremental n-gram merge and a tailed URL queue."""
