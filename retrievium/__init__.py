"""Retrieval-dataset analytics on Spark: operators are lazy DataFrame and Column functions."""
