"""questrel: work-queue and discovery analytics on Spark DataFrames."""
