"""Analytics of software-engineering agent trajectories on PySpark."""
