"""Panels over the sample tables, and a registered query and SQL for each operator."""
