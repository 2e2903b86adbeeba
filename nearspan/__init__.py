"""nearspan: approximate string and sequence matching on Spark DataFrames."""
