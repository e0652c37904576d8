"""Structured Streaming counterparts of the packet and scoring operators."""
