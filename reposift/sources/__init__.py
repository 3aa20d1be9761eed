"""Where tables come from and go to: text, files, Parquet folders, JDBC."""
