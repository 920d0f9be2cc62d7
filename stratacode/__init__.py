"""Repository analytics as PySpark DataFrame jobs.

Every operator takes and returns DataFrames, handles all repositories at once
(``repo_id`` is part of every key) and defines its own row order and tie-break.
"""
