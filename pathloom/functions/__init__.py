"""Part of pathloom."""
