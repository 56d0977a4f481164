"""Panels from and to rows, wide tables and files."""
