"""lumenframe: frames, signals and signatures as Spark DataFrames."""
