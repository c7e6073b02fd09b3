"""Test-redundancy analytics and corpus preparation on Spark DataFrames."""
