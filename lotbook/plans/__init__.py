"""Jobs: compositions of operators from landed data to published tables."""
