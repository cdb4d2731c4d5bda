"""Part of the span analytics engine."""
