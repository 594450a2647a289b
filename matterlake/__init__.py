"""matterlake: contract and deal analytics as Spark DataFrame operators.

Every operator takes DataFrames (a table, or a table of requests) and returns a
DataFrame.  The tenant column ``firm_id`` is part of every key.
"""

__version__ = "0.1.0"
