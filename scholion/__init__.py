"""Bibliometric search, linking and evaluation operators over Spark DataFrames."""
