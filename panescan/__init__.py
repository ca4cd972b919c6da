"""panescan - visual defect inspection analytics as Spark DataFrame jobs.

Rasters live in three interchangeable forms: ``tiles`` (grey values, Arrow/NumPy
inside tasks), ``runs`` (class masks, pure JVM) and ``pixels`` (clear, for edges
and tests).  Every operator takes and returns DataFrames.
"""
