"""Jobs: compositions of operators from inputs to result tables."""
