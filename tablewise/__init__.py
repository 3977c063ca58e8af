"""Table profiling, cleaning, feature building, evaluation and monitoring on Spark DataFrames."""
