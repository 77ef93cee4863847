"""What is settled once on the driver: target shapes, schema compilation, prompt text."""
