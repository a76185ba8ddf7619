"""Operators for large training-text corpora.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; intermediate tables go to the folder that the session names
in ``spark.checkpoint.dir`` (see :mod:`tidewright.llm.common`).
"""
