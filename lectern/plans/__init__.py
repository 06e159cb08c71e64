"""Query catalogue, model workflow and command line."""
