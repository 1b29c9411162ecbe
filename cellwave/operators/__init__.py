"""DataFrame -> DataFrame and Signal -> Signal operators."""
