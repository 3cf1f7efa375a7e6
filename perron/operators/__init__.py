"""Operators over timetables, and running sums and components that all layers use."""
