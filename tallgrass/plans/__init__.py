"""Whole plans: from project roots to reports."""
