"""Evidence retrieval and evaluation over long recordings, on Spark DataFrames."""
