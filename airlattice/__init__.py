"""airlattice: hourly air-quality sensor analytics expressed as Spark DataFrame plans.

Every operator takes and returns DataFrames; series keys (city, sensor, pollutant) are
columns, so one plan handles every sensor at once.
"""

__version__ = "0.1.0"
