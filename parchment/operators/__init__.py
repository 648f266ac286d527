"""Relational operators of extraction, matching, repair, evaluation and export."""
