"""marlstone: warehouse, event-analytics and corpus operators on Spark DataFrames."""
