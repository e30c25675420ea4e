"""The audit: which declared packages are used, how and where."""
