"""sluice: declarative, rule-driven record transformation on Spark DataFrames."""
