"""Whole plans: registered queries and report assembly."""
