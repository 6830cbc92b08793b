"""kickmill: match, odds and corpus analytics on PySpark."""
