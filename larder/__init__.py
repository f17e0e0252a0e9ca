"""Recipe-data jobs and corpus operators as PySpark DataFrame functions."""
