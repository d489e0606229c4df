"""Readers and writers of tasks, corpora, annotations, settings, probe libraries and trial results."""
