"""seqlake: genome alignment, tandem repeat, mask and sequence data as Spark DataFrames."""
