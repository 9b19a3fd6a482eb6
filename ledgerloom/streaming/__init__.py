"""Incremental reading of slips."""
