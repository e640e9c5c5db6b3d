"""Column expressions for one voxel at a time, and the scalar mathematics behind them."""
