"""Readers and writers of the file layouts that traces, evaluators, books and corpora are kept in."""
