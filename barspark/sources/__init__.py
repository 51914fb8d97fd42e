"""Reading and writing bars, reports, distributions and models."""
