"""Dock events: the same operators over a finished table and over a stream."""
