"""faultbench: seeded data-fault campaigns against data-quality controls, on Spark.

Faults are DataFrame transformations over copies of tables; every fault variant of a
table shares one DataFrame with the clean table (see ``faultbench.operators.variants``),
downstream tables are rebuilt for all variants in the same jobs, and controls,
checksums and blast radius are computed per variant from those shared jobs.
"""

__version__ = "0.1.0"
