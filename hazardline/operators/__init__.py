"""DataFrame operators: ``DataFrame -> DataFrame``, column names as arguments."""
