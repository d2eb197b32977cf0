"""Operators that prepare source code and documents as training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it is there.
"""
