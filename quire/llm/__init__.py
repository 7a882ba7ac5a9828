"""Operators for preparing training text at scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its
queries only where the folder is present.
"""
