"""foliospark: document structuring and evaluation on PySpark DataFrames."""
