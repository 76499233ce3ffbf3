"""functions of plazametrics."""
