"""Registered queries, their fixture views and the SQL they are checked against."""
