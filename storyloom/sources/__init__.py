"""Readers and writers of texts, graphs, results and versions."""
