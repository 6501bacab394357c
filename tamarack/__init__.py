"""tamarack: company-lead data processing and training-data operators on PySpark DataFrames."""
