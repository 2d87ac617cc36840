"""Where row sets come from and where they go."""
