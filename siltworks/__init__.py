"""siltworks: Spark-native operators for scoring bodies of text and code against rubrics.

Every operator is a function from DataFrames to DataFrames. The subpackage ``llm`` holds the
training-data operators; nothing else in the package imports it.
"""
