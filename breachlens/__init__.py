"""Exposed-credential analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (scans), ``operators``
(DataFrame -> DataFrame), ``plans`` (whole imports and the stored tables) and
``streaming`` (the same imports fed by Structured Streaming).
"""

__version__ = "0.1.0"
