"""tessera: a DataFrame-first record-linkage and corpus-analytics engine on PySpark."""
