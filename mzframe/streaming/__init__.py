"""The same operators over unbounded tables."""
