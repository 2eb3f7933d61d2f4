"""Reading the delivery tables and writing results."""
