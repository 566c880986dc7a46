"""meshframe: raster, point and mesh analytics on PySpark DataFrames."""
