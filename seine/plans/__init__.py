"""Whole plans: scans and reports."""
