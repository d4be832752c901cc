"""rfrank: rank broadcast transmitters around receivers with Spark DataFrames."""
