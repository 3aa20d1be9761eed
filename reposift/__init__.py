"""Mining of source-repository data as Spark jobs: DataFrames in, DataFrames out."""
