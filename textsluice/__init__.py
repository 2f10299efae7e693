"""Text reduction, log analytics and corpus operators as PySpark DataFrame transformations."""
