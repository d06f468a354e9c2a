"""Registered queries of the session jobs and the SQL they are held against."""
