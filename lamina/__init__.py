"""lamina: a strictly typed layer of relational, partition-aware and SQL operators over Spark DataFrames."""
