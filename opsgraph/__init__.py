"""opsgraph: analytics over streams of resource snapshots, as Spark DataFrames."""
