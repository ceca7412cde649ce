"""minnow: a declarative retrieval and analytics layer on PySpark."""
