"""Comment and corpus analytics as Spark DataFrame plans."""
