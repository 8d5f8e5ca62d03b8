"""Relational operators over ordered read, line and contig frames."""
