"""Relational operators: joins, windows, cohort statistics, ranking."""
