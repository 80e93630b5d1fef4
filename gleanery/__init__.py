"""gleanery: document-retrieval analytics on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame.  The subpackage
``gleanery.llm`` holds the training-data operators; nothing outside it imports it.
"""
