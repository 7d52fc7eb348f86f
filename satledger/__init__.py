"""satledger: value-for-value payment analytics as Spark DataFrame functions.

Every public operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``; nothing is collected to the driver inside an
operator, and every time bound (``since``, ``as_of``) is a parameter.
"""

__version__ = "0.1.0"
