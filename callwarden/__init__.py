"""callwarden: tool-call policy, scanning, budget and audit analytics on Spark.

Everything is a function from DataFrames (or Columns) to DataFrames (or Columns);
nothing here runs an action unless its docstring says so.
"""

__version__ = "0.1.0"
