"""Streams of samples. An extension: the reference reads whole files only."""
