"""moodstream: listening-history analytics as plain PySpark DataFrame functions."""
