"""Table operators: each takes DataFrames (and parameters) and returns a
DataFrame; none collects an unbounded result to the driver."""
