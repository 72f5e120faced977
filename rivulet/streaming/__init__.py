"""Structured Streaming counterparts of operators that batch queries run over whole tables."""
