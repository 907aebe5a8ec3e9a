"""Tideline: event-time market analytics on plain DataFrames."""
