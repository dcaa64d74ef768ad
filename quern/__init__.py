"""quern: a Spark-native data-mining engine. Every operator is a function from DataFrames to a DataFrame."""
