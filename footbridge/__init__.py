"""Walkable changes of train as Spark jobs over map, timetable and live tables."""
