"""ctxspark: preparing, transforming and evaluating data for context-compression models on Spark."""
