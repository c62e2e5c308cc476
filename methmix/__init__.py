"""Cell-type mixture analytics over DNA-methylation reads, built on Spark DataFrames."""
