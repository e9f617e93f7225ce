"""streamlanes: multi-channel stream analytics on Spark DataFrames."""
