"""The two query languages, their common commands, and plans."""
