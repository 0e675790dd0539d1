"""tessera: a Spark engine for versioned code and text collections.

Everything is a function from DataFrames to DataFrames; see the README for the
map of modules.  The subpackage ``llm`` holds the operators for training data
and nothing outside it imports it.
"""

__version__ = "0.1.0"
