"""Where runs and outputs are kept."""
