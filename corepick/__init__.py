"""corepick: coreset selection and training-data preparation on Spark DataFrames."""
