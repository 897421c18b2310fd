"""Operators for training-data corpora: cleaning, duplicate search, decontamination, packing."""
