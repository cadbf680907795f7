"""Part of talentlake."""
