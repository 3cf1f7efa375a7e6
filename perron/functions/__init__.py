"""Column functions of the timetable domain, and comparison of frames."""
