"""Query registries."""
