"""Origin-destination ridership analytics on Spark DataFrames."""
