"""Pagewright: document-block dataflows and analytics on Spark DataFrames."""
