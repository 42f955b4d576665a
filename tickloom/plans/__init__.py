"""Registered queries, and the SQL that each is held against."""
