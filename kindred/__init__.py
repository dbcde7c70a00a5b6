"""kindred: find, group and judge similar units of text or code on Spark.

Every operator is a plain function: DataFrame(s) in, DataFrame out. Column
names are arguments with defaults. See README.md for the operator map.
"""

__version__ = "0.1.0"
