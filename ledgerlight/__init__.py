"""Attribution, disclosure and corpus operators on PySpark DataFrames."""
