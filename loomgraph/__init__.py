"""loomgraph: a PySpark-native analytics engine for knowledge graphs and the text behind them."""
