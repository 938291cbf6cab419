"""tabwright: judge, protect, compare and synthesise tables with Spark DataFrames."""
