"""Readers and writers for the file formats the tables come from."""
