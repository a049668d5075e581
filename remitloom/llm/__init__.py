"""Operators for text corpora: container packing, source mixing, personal information."""
