"""Readers and writers of case files, configurations, logs, evidence and tables."""
