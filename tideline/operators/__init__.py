"""Operators on series: every one takes and returns a DataFrame keyed by series and time."""
