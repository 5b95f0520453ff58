"""kernelspark: kernel, low-rank and calibration analytics as Spark DataFrame jobs.

Layout
------
functions/  column-expression building blocks (keyed random numbers, array maths,
            kernels, link functions)
sources/    readers and writers (driver tables, manifests, file listings, bundles)
operators/  the analytics operators (quality, prep, kernels, low-rank, posterior,
            predict, metrics, chains, trials)
plans/      named queries over the driver tables + their DuckDB oracle SQL
streaming/  incremental (Structured Streaming) runs
"""

__version__ = "0.1.0"
