"""operators of plazametrics."""
