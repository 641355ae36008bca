"""Document analytics on Spark: page algebra, text metrics, layout and scores as DataFrame operators."""
