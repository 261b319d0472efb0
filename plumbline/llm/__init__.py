"""Operators of a training-data pipeline: cleaning, near duplicates, decontamination, scoring, mixing and archives."""
