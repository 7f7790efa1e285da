"""Whole answers composed of operators: run list, overview, timeline, queue page, scheduler tick."""
