"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Every operator reads
only the columns it names; where one returns the rows that it was given, its
helper columns get names that no column of these rows has.
"""
