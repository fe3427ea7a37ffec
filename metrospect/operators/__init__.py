"""DataFrame operators: DataFrame in, DataFrame out, no driver-side row loops."""
