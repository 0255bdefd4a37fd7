"""Evidence-gated attribute engine built on PySpark DataFrames."""
