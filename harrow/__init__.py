"""harrow: cohort analytics and training-data operators as PySpark DataFrame programs."""
