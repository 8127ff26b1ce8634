"""Part of soundtally."""
