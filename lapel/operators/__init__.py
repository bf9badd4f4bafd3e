"""Questions, reports and policies: functions from a star and parameters to a lazy DataFrame."""
