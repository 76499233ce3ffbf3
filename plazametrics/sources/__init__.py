"""sources of plazametrics."""
