"""Part of streamlanes."""
