"""Streams need no operators of their own: functions on tiles keep no state and run on streaming frames, and
the aggregates over cells are built-in ones, so they work under watermarks and windows.
"""
