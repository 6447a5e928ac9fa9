"""Readers, writers, the relational source tables, the evaluations log and the model store."""
