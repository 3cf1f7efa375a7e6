"""Feeds, their configuration and sinks, and a timetable over the events table."""
