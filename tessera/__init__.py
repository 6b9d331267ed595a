"""tessera: text-mining, recommendation and corpus operators as PySpark DataFrame functions."""
