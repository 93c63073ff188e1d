"""laminar: leaf-damage measurement on Spark.

Masks are tables of horizontal runs, photographs are tables of pixels, and
every measurement is a DataFrame plan.
"""

__version__ = "0.1.0"
