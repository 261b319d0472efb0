"""Readers and parsers that give the tables the operators work on."""
