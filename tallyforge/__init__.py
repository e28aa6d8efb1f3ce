"""Tallyforge: minibatch-style machine learning and data preparation as Spark DataFrame operators."""
