"""Review trust scoring on Spark: signals, trust index, labelled data, evaluation, diagnosis, streams."""
