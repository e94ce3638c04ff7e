"""Image-grading analytics on Spark DataFrames: manifests, features, folds, models and scoring."""
