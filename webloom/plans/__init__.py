"""Jobs: compositions of operators into whole pipelines."""
