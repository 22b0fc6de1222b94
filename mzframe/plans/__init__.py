"""Plans of how arrays are encoded."""
