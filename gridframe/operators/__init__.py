"""Planning and assembly operators over DataFrames."""
