"""Operators put together: portfolio scoring, training, unsupervised analysis and the query catalog."""
