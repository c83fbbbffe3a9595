"""factloom: fact analysis and corpus processing as PySpark DataFrame jobs."""
