"""plans of plazametrics."""
