"""Loomspan: content matching, interval maps and corpus preparation on PySpark."""
