"""Jobs built from the operators: batch run, classify-and-merge run, and the query set."""
