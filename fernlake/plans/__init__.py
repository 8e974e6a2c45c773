"""Whole runs composed of operators, and their command line."""
