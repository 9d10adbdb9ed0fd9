"""Training-data operators: ten corpus operations built on Spark.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library intact.
"""
