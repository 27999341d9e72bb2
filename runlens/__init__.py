"""runlens: PySpark operators for analysing recorded agent runs and text corpora."""
