"""Readers and writers of data sets and run logs."""
