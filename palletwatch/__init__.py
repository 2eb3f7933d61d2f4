"""Watching inbound deliveries with PySpark: receipts, lead times, suppliers, dock events."""
