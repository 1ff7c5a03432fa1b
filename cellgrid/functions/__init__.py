"""Column expressions and the fixed value tables behind them."""
