"""Relational operators: eligibility, profiles, ranking, coverage, statistics."""
