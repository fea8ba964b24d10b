"""Relational and model operators over detections."""
