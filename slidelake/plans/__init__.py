"""Multi-step plans that chain several operators into one lazy job."""
