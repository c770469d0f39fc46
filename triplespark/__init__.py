"""Knowledge graphs as tables of triples, worked on with Spark DataFrames."""
