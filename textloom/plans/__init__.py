"""Operators bound to the supplied tables, each with SQL that gives the same rows."""
