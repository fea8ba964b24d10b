"""Readers of sensor logs, tables and projects."""
